"""Readers: by suffix, tolerant JSON lines, three layouts of security lists, XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its path's suffix: .parquet, .json, .jsonl, .csv; ValueError for another."""
    r = spark.read.schema(schema) if schema else spark.read
    p = path.rstrip("/*").lower()
    if p.endswith(".parquet"):
        return r.parquet(path)
    if p.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return r.json(path)
    if p.endswith(".csv"):
        return r.option("header", True).csv(path)
    raise ValueError(f"unknown format: {path}")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a given schema; blank and broken lines are dropped."""
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "payload"), schema)


def parse_lines(lines: DataFrame, schema: str, col: str = "payload") -> DataFrame:
    """The objects of a text column by schema, one row each; texts that are no JSON object are dropped."""
    ok = lines.where(F.col(col).rlike(r"^\s*\{.*\}\s*$"))
    return ok.select(F.from_json(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"}).alias("o"), F.try_parse_json(col).isNotNull().alias("ok")).where("ok").select("o.*")


def read_recursive(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """All files below a folder whose name matches the pattern, as multi-line JSON."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(folder)


def securities(df: DataFrame, layout: str, col: str = "payload") -> DataFrame:
    """``(cik, symbol, name, exchange)`` of a text column in one of three layouts.

    ``fields``: {"fields": [...], "data": [[...]]}; ``numbered``: {"0": {cik_str, ticker, title}, ...}; ``lines``: one object a row.
    """
    if layout == "fields":
        j = df.select(F.from_json(col, "fields array<string>, data array<array<string>>").alias("j"))
        x = j.select("j.fields", F.explode("j.data").alias("r"))
        get = lambda *n: F.coalesce(*[F.try_element_at("r", F.nullif(F.array_position("fields", F.lit(k)).cast("int"), F.lit(0))) for k in n])
        out = x.select(get("cik").alias("cik"), get("ticker", "symbol").alias("symbol"), get("name", "title").alias("name"), get("exchange").alias("exchange"))
    elif layout in ("numbered", "lines"):
        item = "struct<cik:string,cik_str:string,ticker:string,symbol:string,title:string,name:string,exchange:string>"
        x = df.select(F.explode(F.map_values(F.from_json(col, f"map<string,{item}>"))).alias("o")) if layout == "numbered" else df.select(F.from_json(col, item).alias("o"))
        out = x.where("o IS NOT NULL").select(F.coalesce("o.cik", "o.cik_str").alias("cik"), F.coalesce("o.symbol", "o.ticker").alias("symbol"), F.coalesce("o.name", "o.title").alias("name"), F.col("o.exchange").alias("exchange"))
    else:
        raise ValueError(f"unknown layout {layout}")
    return out.withColumn("cik", F.when(F.col("cik").isNotNull(), F.lpad("cik", 10, "0"))).where("symbol IS NOT NULL")


def xbrl_candidates(files: DataFrame) -> DataFrame:
    """``files(doc, name)`` to likely XBRL instances with ``rank`` (1 is best): no schema, linkbase or summary files; ``_htm.xml`` first."""
    x = files.where(F.lower("name").rlike(r"\.xml$") & ~F.lower("name").rlike(r"(_cal|_def|_lab|_pre)\.xml$|filingsummary|^r\d+\.xml$"))
    order = F.struct((~F.lower("name").endswith("_htm.xml")).alias("a"), F.length("name").alias("n"), "name")
    from pyspark.sql import Window

    return x.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(order)))


def read_zipped_csv(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The CSV files inside the ZIP archives of a path, each as a table by its name without suffix, types inferred.

    An archive is opened by one task, which gives the files' lines with their place; broken archives give none.
    """
    import io
    import zipfile

    from pyspark.sql import Row

    def lines(file: tuple[str, bytes]):
        try:
            with zipfile.ZipFile(io.BytesIO(file[1])) as z:
                for n in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                    with z.open(n) as f:
                        for i, line in enumerate(io.TextIOWrapper(f, "utf-8-sig", errors="replace")):
                            yield Row(name=n.rpartition("/")[2][:-4], archive=file[0], line_no=i, line=line.rstrip("\r\n"))
        except zipfile.BadZipFile:
            return

    files = spark.sparkContext.binaryFiles(path)
    rows = spark.createDataFrame(files.flatMap(lines), "name string, archive string, line_no bigint, line string")
    names = [r.name for r in rows.select("name").distinct().orderBy("name").collect()]
    own = lambda n: rows.where(F.col("name") == n)
    # a file's header is its first line; lines keep their own order within an archive's task
    return {n: spark.read.option("header", True).option("inferSchema", True).option("enforceSchema", False).csv(own(n).select("line").rdd.map(lambda r: r.line)) for n in names}


def zipped_csv_to_parquet(spark: SparkSession, path: str, folder: str) -> list[str]:
    """One Parquet table below ``folder`` for each CSV file inside the ZIP archives of a path; the tables' paths."""
    out = []
    for name, df in read_zipped_csv(spark, path).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        out.append(f"{folder}/{name}.parquet")
    return out
