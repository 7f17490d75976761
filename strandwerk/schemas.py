"""Canonical schemas and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, MapType, StringType, StructField, StructType

TICKER = "struct<id:bigint,uuid:string,symbol:string,exchange:string>"
COMPANY = (
    f"id bigint, uuid string, name string, cik string, ticker {TICKER}, description string, website_url string, headquarters_location string, jurisdiction string, revenue_usd bigint, employees bigint,"
    " founded_year bigint, ceo string, linkedin_url string, source_ids array<bigint>, source_uuids array<string>, match_skip boolean, match_skip_reason string, match_skip_history array<bigint>"
)
PRODUCT = "id bigint, uuid string, name string, description string, manufacturer bigint, technologies array<bigint>, source_ids array<bigint>, source_uuids array<string>"
TECHNOLOGY = "id bigint, uuid string, name string, developer bigint, description string, source_ids array<bigint>, source_uuids array<string>"
RELATIONSHIP = (
    "src_company bigint, dst_company bigint, type string, technologies array<bigint>, products array<bigint>, description string, percentage double, amount double, currency string,"
    " country struct<common_name:string,full_name:string,iso_2:string,iso_3:string,gdp:double>, date string, quarter string, contract_duration_years bigint, segment_ids array<bigint>, geographic_scope string, is_material boolean"
)


def _struct(ddl: str) -> str:
    import re

    depth, out = 0, []
    for part in re.split(r"([<>,])", ddl):
        depth += (part == "<") - (part == ">")
        out.append(part if depth or part in "<>," else re.sub(r"^(\s*\w+)\s+", r"\1:", part))
    return "struct<" + "".join(out).replace(" ", "") + ">"


ARTICLE = (
    "article_id bigint, title string, url string, posted_at string, collected_at string, summary string, source struct<name:string,url:string>, authors array<struct<name:string,profile_url:string>>,"
    f" companies array<{_struct(COMPANY)}>, tickers array<{TICKER}>, products array<{_struct(PRODUCT)}>, technologies array<{_struct(TECHNOLOGY)}>, relationships array<{_struct(RELATIONSHIP)}>, cited_sources array<struct<name:string,url:string>>"
)
# Exchange codes (others count as UNK) and relationship types.
EXCHANGE_CODES = (
    "UN UQ UA UR UM UW UV UP CT CV CN LN GR FP NA BB IM ID PL NO SM SW DC SS FH PW AV CP GA TI JT HK SP CH CZ KS TT IB IN IJ TB PM MK AT NZ BZ MM AR CB PE SJ IT AB DH DU QD EY UNK"
).split()
RELATIONSHIP_TYPES = (
    "Supplier Acquisition Financing Investment Partnership Licensing Subsidiary OEM Competitor Customer JointVenture Litigation Regulatory ResearchCollaboration"
    " DistributionAgreement SupplyAgreement LicenseIn LicenseOut MaterialContract RevenueStream IntellectualProperty"
).split()
BLOCK_FIELDS = ("block_key", "block_key_type", "companies", "block_size")


def schema_of(ddl: str) -> StructType:
    """The StructType of a DDL text."""
    return StructType.fromDDL(ddl)


def widen(kind: DataType) -> DataType:
    """Every integer of a type, at any depth, as BIGINT."""
    if isinstance(kind, IntegerType):
        return LongType()
    if isinstance(kind, ArrayType):
        return ArrayType(widen(kind.elementType), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(widen(kind.keyType), widen(kind.valueType), kind.valueContainsNull)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, widen(f.dataType), f.nullable) for f in kind.fields])
    return kind


#: Fields of nested objects that hold references by number.
ID_FIELDS = ("id", "manufacturer", "developer", "src_company", "dst_company", "products", "technologies", "segment_ids", "source_ids")


def ids_as_text(kind: DataType, names: tuple[str, ...] = ID_FIELDS) -> DataType:
    """A type with the integers (or lists of them) of the named fields as strings, at any depth, as after a re-keying to uuids."""
    if isinstance(kind, ArrayType):
        return ArrayType(ids_as_text(kind.elementType, names), kind.containsNull)
    if isinstance(kind, StructType):
        fields = []
        for f in kind.fields:
            t = ids_as_text(f.dataType, names)
            if f.name in names and isinstance(t, (IntegerType, LongType)):
                t = StringType()
            elif f.name in names and isinstance(t, ArrayType) and isinstance(t.elementType, (IntegerType, LongType)):
                t = ArrayType(StringType(), t.containsNull)
            fields.append(StructField(f.name, t, f.nullable))
        return StructType(fields)
    return kind


def without_nulls(c: Column) -> Column:
    """A nested value as JSON text without its NULL fields, at any depth; NULL elements of lists stay."""
    return F.to_json(c, {"ignoreNullFields": "true"})


def normalize_companies(df: DataFrame, keep_extra: bool = False) -> DataFrame:
    """The canonical company columns in order, cast; typed NULLs for missing ones; other columns dropped or kept behind."""
    fields = schema_of(COMPANY).fields
    names = {f.name for f in fields}
    cols = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns and not isinstance(f.dataType, (StructType,)) else (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)) for f in fields]
    extra = [F.col(f"`{c}`") for c in df.columns if c not in names and not c.startswith("block_")] if keep_extra else []
    return df.select(*cols, *extra)


def require(df: DataFrame, columns: tuple[str, ...] = BLOCK_FIELDS) -> DataFrame:
    """``df`` itself; ValueError if a required column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def flat_columns(df: DataFrame, separator: str = ", ") -> DataFrame:
    """``df`` for flat sinks: each struct's fields as ``<column>_<field>``, each list as text beside its size ``n_<column>``.

    NULL and empty lists give an empty text and 0; NULL elements are left out of the text but counted.  A made name
    that another column has gets an underscore behind.
    """
    taken, out = {f.name.lower() for f in df.schema.fields}, []

    def name(n: str) -> str:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        return n

    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StructType):
            out += [c.getField(g.name).alias(name(f"{f.name}_{g.name}")) for g in f.dataType.fields]
        elif isinstance(f.dataType, ArrayType):
            scalar = not isinstance(f.dataType.elementType, (StructType, ArrayType, MapType))
            text = F.array_join(c.cast("array<string>"), separator) if scalar else F.to_json(c)
            out += [F.coalesce(text, F.lit("")).alias(f.name), F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(name(f"n_{f.name}"))]
        else:
            out.append(c)
    return df.select(*out)
