"""Returns, company facts by tag priority, cascades of sources, XBRL instances, filings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwerk.functions.text import flexible_date
from strandwerk.operators.joins import lookup

# XBRL tags of each financial concept, in order of priority.
CONCEPTS = {
    "EntityRegistrantName": ["dei:EntityRegistrantName"],
    "DocumentType": ["dei:DocumentType"],
    "DocumentPeriodEndDate": ["dei:DocumentPeriodEndDate", "us-gaap:DocumentPeriodEndDate", "us-gaap:BalanceSheetDate"],
    "Assets": ["us-gaap:Assets"],
    "AssetsCurrent": ["us-gaap:AssetsCurrent"],
    "CashAndCashEquivalents": ["us-gaap:CashAndCashEquivalentsAtCarryingValue"],
    "Liabilities": ["us-gaap:Liabilities"],
    "LiabilitiesCurrent": ["us-gaap:LiabilitiesCurrent"],
    "Equity": ["us-gaap:StockholdersEquity", "us-gaap:StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "us-gaap:PartnersCapital"],
    "Revenue": ["us-gaap:Revenues", "us-gaap:Revenue", "us-gaap:SalesRevenueNet", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax"],
    "CostOfRevenue": ["us-gaap:CostOfRevenue", "us-gaap:CostOfGoodsAndServicesSold"],
    "GrossProfit": ["us-gaap:GrossProfit"],
    "OperatingExpenses": ["us-gaap:OperatingExpenses"],
    "OperatingIncomeLoss": ["us-gaap:OperatingIncomeLoss"],
    "NetIncomeLoss": ["us-gaap:NetIncomeLoss", "us-gaap:ProfitLoss", "us-gaap:IncomeLossFromContinuingOperations"],
    "EPSBasic": ["us-gaap:EarningsPerShareBasic"],
    "EPSDiluted": ["us-gaap:EarningsPerShareDiluted"],
    "CashFlowOperating": ["us-gaap:NetCashProvidedByUsedInOperatingActivities"],
    "CashFlowInvesting": ["us-gaap:NetCashProvidedByUsedInInvestingActivities"],
    "CashFlowFinancing": ["us-gaap:NetCashProvidedByUsedInFinancingActivities"],
    "CapEx": ["us-gaap:PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap:CapitalExpenditures", "us-gaap:PurchaseOfPropertyPlantAndEquipment"],
}


def returns(prices: DataFrame, symbol: str = "symbol", time: str = "ts", close: str = "close") -> DataFrame:
    """``(symbol, first_close, last_close, return_pct)``, best first; symbols without prices, or with a missing or zero start, have none."""
    p = prices.where(F.col(time).isNotNull()).groupBy(F.col(symbol).alias("symbol")).agg(F.min_by(close, time).alias("first_close"), F.max_by(close, time).alias("last_close"))
    p = p.where("first_close IS NOT NULL AND first_close <> 0 AND last_close IS NOT NULL")
    return p.select("symbol", "first_close", "last_close", F.round(100.0 * (F.col("last_close") - F.col("first_close")) / F.col("first_close"), 6).alias("return_pct")).orderBy(F.desc("return_pct"), "symbol")


def concept_table(spark) -> DataFrame:
    """``(concept, tag, tag_rank)`` of CONCEPTS."""
    return spark.createDataFrame([(c, t, i) for c, ts in CONCEPTS.items() for i, t in enumerate(ts)], "concept string, tag string, tag_rank int")


def latest_facts(facts: DataFrame) -> DataFrame:
    """``(entity, tag, val, end, filed)``: each tag's latest fact by period end, then filing, then value."""
    return facts.groupBy("entity", "tag").agg(F.max_by(F.struct("val", "end", "filed"), F.struct("end", "filed", "val")).alias("f")).select("entity", "tag", "f.val", "f.end", "f.filed")


def concept_values(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(entity, concept, tag, val, end)``: for each concept the latest fact of the first tag in priority that has any."""
    x = latest_facts(facts.where("val IS NOT NULL AND end IS NOT NULL")).join(lookup(concepts), "tag")
    return x.groupBy("entity", "concept").agg(F.min_by(F.struct("tag", "val", "end"), "tag_rank").alias("f")).select("entity", "concept", "f.tag", "f.val", "f.end")


def recent_form(facts: DataFrame, form: str, year: int) -> DataFrame:
    """The facts of ``facts(form, filed, ...)`` reported in a form and filed in the year or later; unreadable dates are none."""
    filed = F.col("filed") if dict(facts.dtypes)["filed"] in ("date", "timestamp") else flexible_date(F.col("filed"))
    return facts.where((F.col("form") == form) & (F.year(filed) >= year))


def company_facts(facts: DataFrame, concepts: DataFrame, form: str, year: int) -> DataFrame:
    """``(entity, concept, tag, val, end)``: each concept's value by tag priority, then recency, among the facts of one form filed lately enough."""
    return concept_values(recent_form(facts, form, year), concepts)


def facts_in_context(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``facts(doc, context_id, ...)`` with ``end`` and ``dims`` of their ``contexts(doc, context_id, end, dims)``; facts of no context have no row."""
    c = contexts.groupBy("doc", "context_id").agg(F.min(F.struct("dims", "end")).alias("c"))
    return facts.drop("end", "dims").join(c.select("doc", "context_id", F.col("c.end").alias("end"), F.col("c.dims").alias("dims")), ["doc", "context_id"])


def instance_values(facts: DataFrame, contexts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(doc, end, concept, tag, val)``: for each concept and period of an instance the fact of the first tag in
    priority, of those without dimensions first, then the first seen; ``facts(doc, context_id, tag, val, seq)``."""
    x = facts_in_context(facts, contexts).where("val IS NOT NULL AND end IS NOT NULL").join(lookup(concepts), "tag")
    order = F.struct("tag_rank", (F.col("dims") > 0).alias("d"), "seq")
    return x.groupBy("doc", "end", "concept").agg(F.min_by(F.struct("tag", "val"), order).alias("f")).select("doc", "end", "concept", "f.tag", "f.val")


def distinct_symbols(*tables: DataFrame, col: str = "ticker") -> DataFrame:
    """``(ticker)``: the different symbols of several tables; NULL and empty ones are none."""
    out = None
    for df in tables:
        part = df.select(F.col(col).alias("ticker")).where("ticker <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def in_filing_window(facts: DataFrame, days: int = 150) -> DataFrame:
    """The facts filed after their period's end, within so many days."""
    gap = F.datediff("filed", "end")
    return facts.where((gap > 0) & (gap <= days))


def cascade(sources: list[tuple[str, DataFrame]], key: list[str], value: str = "val") -> DataFrame:
    """``(key, value, source_method)``: the value of the first source that has it, gaps filled by the next ones."""
    u = None
    for i, (name, df) in enumerate(sources):
        part = df.where(F.col(value).isNotNull()).select(*key, value, F.lit(name).alias("source_method"), F.lit(i).alias("_i"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy(*key).agg(F.min_by(F.struct(value, "source_method"), F.struct("_i", value)).alias("b")).select(*key, f"b.{value}", "b.source_method")


def best_facts(facts: DataFrame) -> DataFrame:
    """One fact for each (doc, tag): those without dimensions first, then the first seen; ``facts(doc, tag, dims, seq, val)``."""
    return facts.groupBy("doc", "tag").agg(F.min_by("val", F.struct((F.col("dims") > 0).alias("d"), F.col("seq"))).alias("val"))


def enough_items(values: DataFrame, items: tuple[str, ...], least: int = 3) -> DataFrame:
    """``(entity, present, ok)``: how many of the key items an entity has."""
    v = values.groupBy("entity").agg(F.count_distinct(F.when(F.col("concept").isin(*items), F.col("concept"))).alias("present"))
    return v.withColumn("ok", F.col("present") >= least)


def filings(index: DataFrame, form: str, limit: int) -> DataFrame:
    """``index(cik, form[], accession[], filed[])``, parallel arrays, to the newest ``limit`` filings of a form for each cik; accession numbers without dashes."""
    rows = index.select("cik", F.inline(F.arrays_zip("form", "accession", "filed"))).where(F.col("form") == form)
    newest = Window.partitionBy("cik").orderBy(F.desc("filed"), F.desc("accession"))
    top = rows.withColumn("i", F.row_number().over(newest)).where(F.col("i") <= limit)
    return top.select(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.regexp_replace("accession", "-", "").alias("accession"), "filed")


def xbrl_facts(docs: DataFrame, key: str = "doc", xml: str = "xml") -> DataFrame:
    """``(key, tag, context_id, unit, val, dims, end, seq)``: the facts of XBRL instances joined with their contexts; broken documents give none."""
    import pyarrow as pa
    from pyspark.sql.types import IntegerType, StringType

    schema = docs.select(key).schema.add("tag", StringType()).add("context_id", StringType()).add("unit", StringType()).add("val", StringType()).add("dims", IntegerType()).add("end", StringType()).add("seq", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ET

        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                local = lambda e: e.tag.rpartition("}")[2]
                contexts = {}
                for c in root:
                    if local(c) == "context":
                        ends = [e.text for e in c.iter() if local(e) in ("endDate", "instant")]
                        contexts[c.get("id")] = (sum(local(e) in ("explicitMember", "typedMember") for e in c.iter()), (ends or [None])[0])
                for i, e in enumerate(root):
                    ref = e.get("contextRef")
                    if ref in contexts:
                        space = e.tag.rpartition("}")[0].strip("{").rstrip("/").rpartition("/")
                        prefix = "dei" if "dei" in e.tag else "us-gaap" if "us-gaap" in e.tag else space[2]
                        rows.append((k, f"{prefix}:{local(e)}", ref, e.get("unitRef"), (e.text or "").strip(), *contexts[ref], i))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()])], names=[f.name for f in schema.fields])

    return docs.select(key, xml).mapInArrow(run, schema)
