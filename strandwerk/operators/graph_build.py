"""Articles to entity and edge tables: integrity, re-keying, flattening, names for ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.ids import hashed_id
from strandwerk.functions.names import clean_name


def endpoints_ok(companies: Column, relationships: Column) -> Column:
    """Every non-NULL endpoint of the relationships is the id of one of the companies; NULL lists hold nothing."""
    ids = F.coalesce(companies["id"], F.array().cast("array<bigint>"))
    known = lambda x: x.isNull() | F.coalesce(F.array_contains(ids, x), F.lit(False))
    return F.coalesce(F.forall(F.filter(relationships, lambda r: r.isNotNull()), lambda r: known(r["src_company"]) & known(r["dst_company"])), F.lit(True))


def with_integrity(articles: DataFrame) -> DataFrame:
    """``articles`` with ``ok``, whether every relationship's ends are among the article's companies."""
    return articles.withColumn("ok", endpoints_ok(F.col("companies"), F.col("relationships")))


def entity_id(article: Column, i: Column) -> Column:
    """The global id of an article's object; NULL for a NULL id."""
    return F.when(i.isNotNull(), hashed_id(article, i))


def entities(articles: DataFrame, kind: str) -> DataFrame:
    """The objects of one kind, one row each, with ``uuid``, ``article_id``, ``url`` and the object's fields; ids that
    refer to other objects become their uuids.  NULL objects and objects without an id give no row."""
    a = articles.select("article_id", "url", F.explode(F.col(kind)).alias("o")).where("o IS NOT NULL AND o.id IS NOT NULL")
    of = lambda i: entity_id(F.col("article_id"), i)
    cols = [of(F.col("o.id")).alias("uuid"), F.col("article_id"), F.col("url")]
    for f in articles.schema[kind].dataType.elementType.fields:
        c = F.col(f"o.{f.name}")
        if f.name in ("manufacturer", "developer"):
            c = of(c)
        elif f.name == "technologies":
            c = F.transform(F.filter(c, lambda x: x.isNotNull()), of)
        elif f.name == "name":
            c = clean_name(c)
        cols.append(c.alias(f.name))
    return a.select(*cols)


def edges(articles: DataFrame) -> DataFrame:
    """The relationships as edges ``src, dst, relationship, ...`` between uuids; edges with a NULL end give no row."""
    a = articles.select("article_id", "url", "posted_at", F.explode("relationships").alias("r")).where("r.src_company IS NOT NULL AND r.dst_company IS NOT NULL")
    of = lambda i: entity_id(F.col("article_id"), i)
    ids = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), of)
    rest = [F.col(f"r.{f}") for f in ("description", "percentage", "amount", "currency", "country", "date", "quarter", "contract_duration_years", "geographic_scope", "is_material")]
    return a.select(of(F.col("r.src_company")).alias("src"), of(F.col("r.dst_company")).alias("dst"), F.col("r.type").alias("relationship"), "article_id", "url", "posted_at", ids(F.col("r.products")).alias("products"), ids(F.col("r.technologies")).alias("technologies"), *rest)


def valid_edges(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    n = nodes.select("uuid").distinct()
    return e.join(n.withColumnRenamed("uuid", "src"), "src", "left_semi").join(n.withColumnRenamed("uuid", "dst"), "dst", "left_semi")


def names_for_ids(df: DataFrame, key: str, ids: str, names: DataFrame) -> DataFrame:
    """``df`` with the ids of a list replaced by names, in order; unknown ids stay, NULL elements go, a NULL list stays NULL.

    ``names(uuid, name)`` is joined by shuffle or broadcast as its size allows; nothing is collected.
    """
    n = names.where("uuid IS NOT NULL").groupBy("uuid").agg(F.min("name").alias("name"))
    x = df.select(key, F.posexplode(ids).alias("i", "id")).where("id IS NOT NULL").join(n, F.col("id") == F.col("uuid"), "left")
    back = x.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "id").alias("v")))), lambda s: s["v"]).alias("_names"))
    return df.join(back, key, "left").withColumn(ids, F.when(F.col(ids).isNull(), F.col("_names")).otherwise(F.coalesce("_names", F.array().cast("array<string>")))).drop("_names")
