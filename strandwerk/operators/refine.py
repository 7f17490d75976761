"""Lineage remap, merging of duplicate edges and nodes, edge blocks, connected nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.ids import clean_uuid
from strandwerk.functions.names import labels
from strandwerk.operators.blocking import numbered


def lineage(resolved: DataFrame, resolve: str = "all") -> DataFrame:
    """``(source_uuid, uuid)``: what each record was merged into, itself included.

    ``resolve="all"`` keeps every target of a record, ``"canonical"`` the least one, so that no edge is doubled.
    Entries that are no uuid are dropped.
    """
    r = resolved.select(clean_uuid(F.col("uuid")).alias("uuid"), "source_uuids").where("uuid IS NOT NULL")
    pairs = r.select("uuid", F.explode(F.concat(F.array("uuid"), F.coalesce("source_uuids", F.array()))).alias("s")).select(clean_uuid(F.col("s")).alias("source_uuid"), "uuid").where("source_uuid IS NOT NULL")
    return pairs.groupBy("source_uuid").agg(F.min("uuid").alias("uuid")) if resolve == "canonical" else pairs.distinct()


def remap(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with both ends replaced by what they were merged into; edges with an end of no lineage give no row."""
    e = edges.withColumns({"src": clean_uuid(F.col("src")), "dst": clean_uuid(F.col("dst"))})
    s = links.select(F.col("source_uuid").alias("src"), F.col("uuid").alias("_s"))
    d = links.select(F.col("source_uuid").alias("dst"), F.col("uuid").alias("_d"))
    return e.join(s, "src").join(d, "dst").drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"})


def first_known(c: str, order: Column) -> Column:
    """The value of the least order among the non-NULL ones."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)


SCALARS = ("description", "percentage", "amount", "currency", "date", "quarter", "posted_at")


def distinct_lists(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, columns)``: for each key the different non-NULL values of each list column (or scalar), sorted.

    Values are made distinct by (key, column, value) first, with map-side combine, so that a key of many rows brings
    no more to one task than the list that comes out.
    """
    kinds = dict(df.dtypes)
    each = F.array(*[F.struct(F.lit(c).alias("c"), (F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))).alias("x")) for c in columns])
    x = df.select(*keys, F.inline(each)).select(*keys, "c", F.explode("x").alias("x")).where("x IS NOT NULL").distinct()
    return x.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("c") == c, F.col("x")))).alias(c) for c in columns])


def merge_edges(edges: DataFrame, order: tuple[str, ...] = ("posted_at", "rel_id")) -> DataFrame:
    """One edge for each (src, dst, relationship): the earliest known scalars, distinct urls, products, technologies.

    NULL keys are keys like others.
    """
    o, key = F.struct(*order), ["src", "dst", "relationship"]
    out = edges.groupBy(*key).agg(*[first_known(c, o) for c in SCALARS], F.count("*").alias("edges"))
    lists = distinct_lists(edges.withColumnRenamed("url", "urls"), key, ["urls", "products", "technologies"])
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
    out = out.alias("o").join(lists.alias("l"), same[0] & same[1] & same[2], "left")
    some = lambda c: F.coalesce(F.col(f"l.{c}"), F.array().cast("array<string>"))
    return out.select("o.*", some("urls").alias("urls"), labels(some("products")).alias("products"), labels(some("technologies")).alias("technologies"))


def edge_blocks(edges: DataFrame, max_size: int = 10_000) -> DataFrame:
    """``(src, dst, chunk, block_size, relationships)``: the edges of each pair of nodes, ordered by rel_id.

    Pairs of more than ``max_size`` edges come in several chunks, from 1; no task holds more than one chunk.
    Edges with a NULL end form blocks like others.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst", "rel_id", "country")]
    one = edges.withColumns({"_k": F.xxhash64("src", "dst", F.col("src").isNull()), "_o": F.xxhash64(*[F.col(c) for c in edges.columns if c != "country"]).cast("string")})
    n = numbered(one.select("src", "dst", "rel_id", *rest, "_k", "_o"), "_k", "_o")
    n = n.withColumn("chunk", F.when(F.col("total") > max_size, F.floor((F.col("pos") - 1) / max_size).cast("int")).otherwise(0) + 1)
    return n.groupBy("src", "dst", "chunk").agg(F.count("*").alias("block_size"), F.array_sort(F.collect_list(F.struct("rel_id", *rest))).alias("relationships"))


def resolve_edges(edges: DataFrame) -> DataFrame:
    """Edges of one deal merged: same ends, kind and quarter; the latest date, largest amount, all descriptions."""
    key = ["src", "dst", "relationship", "quarter"]
    # each description once, before they meet in one row
    e = edges.groupBy(*key, "description").agg(F.max("date").alias("date"), F.max("amount").alias("amount"), F.count("*").alias("n"))
    return e.groupBy(*key).agg(F.max("date").alias("date"), F.max("amount").alias("amount"), F.array_join(F.array_sort(F.collect_list("description")), " ").alias("description"), F.sum("n").alias("merged"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that are an end of an edge."""
    ends = edges.select(F.col("src").alias("uuid")).unionByName(edges.select(F.col("dst").alias("uuid")))
    return nodes.join(ends, "uuid", "left_semi")


def merge_nodes(nodes: DataFrame, order: tuple[str, ...] = ("iteration", "collected_at", "name")) -> DataFrame:
    """One node for each uuid: the first known scalars, the union of lists, skipped only if all its rows are."""
    o, n = F.struct(*order), nodes.where("uuid IS NOT NULL")
    scalars = [first_known(c, o) for c in ("name", "description", "website_url", "revenue_usd", "employees", "founded_year")]
    out = n.groupBy("uuid").agg(*scalars, F.min("match_skip").alias("match_skip"))
    sets = {c: distinct_lists(n, ["uuid"], [c]) for c in ("source_uuids", "source_ids")}
    for s in sets.values():
        out = out.join(s, "uuid", "left")
    kinds = dict(nodes.dtypes)
    first = ["uuid", "name", "description", "website_url", "revenue_usd", "employees", "founded_year"]
    return out.select(*first, *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in sets], "match_skip")


def with_node_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``src_name`` and ``dst_name``, NULL where the end is no node."""
    n = nodes.groupBy("uuid").agg(F.min("name").alias("name"))
    e = edges.join(n.select(F.col("uuid").alias("src"), F.col("name").alias("src_name")), "src", "left")
    return e.join(n.select(F.col("uuid").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
