"""Merging duplicates inside blocks, with complete lineage.

A matcher names, for each block, which of its companies are one.  The default is deterministic: same match key of
the name.  Everything that went into a block comes out of it: merged, alone, or recovered.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.names import match_key

MERGED = ("description", "cik", "website_url", "headquarters_location", "jurisdiction", "revenue_usd", "employees", "founded_year", "ceo")


class Matcher(Protocol):
    """Gives the group of a company within its block, from its columns; NULL leaves it alone."""

    def __call__(self, members: DataFrame) -> Column: ...


def same_name(members: DataFrame) -> Column:
    """The default matcher: companies of one match key; a company without letters or digits in its name is alone."""
    return F.nullif(match_key(F.col("name")), F.lit(""))


def merge_members(members: DataFrame, iteration: int = 1, matcher: Matcher = same_name) -> DataFrame:
    """``(block_key, uuid, name, ..., source_uuids, match_skip, match_skip_reason)`` from ``members(block_key, id, uuid, name, ..., source_uuids)``.

    Blocks of one company pass by with ``match_skip`` and ``singleton_block``.  The member of the least id is the
    master, the longest name survives, missing fields are filled from the next ids; the lineage is the union of the
    members' uuids and their lineages; the new uuid is a hash of that and the iteration.
    """
    order = F.struct(F.coalesce("id", F.lit(2**62)), F.col("uuid"))
    sizes = members.groupBy("block_key").agg(F.count_distinct("uuid").alias("_n"))
    m = members.withColumn("_g", F.coalesce(matcher(members), F.concat(F.lit("#"), "uuid"))).join(sizes, "block_key")
    fill = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in MERGED if c in members.columns]
    g = m.groupBy("block_key", "_g").agg(
        F.min_by("uuid", order).alias("master_uuid"), F.min("id").alias("id"), F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"), *fill,
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("uuid"), F.coalesce("source_uuids", F.array())))))).alias("source_uuids"), F.max("_n").alias("_n"),
    )
    new = F.md5(F.concat(F.array_join("source_uuids", "|"), F.lit(f"|{iteration}")))
    alone = F.col("_n") == 1
    return g.withColumns({"uuid": F.when(alone, F.col("master_uuid")).otherwise(new), "match_skip": alone, "match_skip_reason": F.when(alone, "singleton_block"), "match_skip_history": F.when(alone, F.array(F.lit(iteration).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))}).drop("_g", "_n")


def recover(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The input records ``(block_key, uuid, ...)`` that no output of their block lists, ready to be put back."""
    known = outputs.select("block_key", F.explode(F.coalesce("source_uuids", F.array())).alias("uuid")).distinct()
    return inputs.join(known, ["block_key", "uuid"], "left_anti").withColumns({"match_skip": F.lit(True), "match_skip_reason": F.lit("missing_in_match_output")})


def append_once(arr: Column, x: Column) -> Column:
    """A list with ``x`` behind it unless it is in it; NULL counts as empty."""
    empty = F.array()
    return F.array_union(F.coalesce(arr, empty), F.array(x))


def local_ids(members: DataFrame, block: str = "block_key", uuid: str = "uuid") -> DataFrame:
    """``members`` with ``local_id``: 1, 2, 3, ... for the distinct uuids of a block in their order."""
    from pyspark.sql import Window

    return members.withColumn("local_id", F.dense_rank().over(Window.partitionBy(block).orderBy(uuid)))


def few_shot_examples(blocks: DataFrame, limit: int = 5) -> DataFrame:
    """``(block_id, companies, merged)``: worked examples for a matcher that learns from them: the records of a block with
    their ids and lineages, and the one entry they became, with the union of their uuids and lineages.

    Only complete blocks serve: one resolved entry, at least two records, an id and a uuid in each.  The ``limit``
    smallest are given (ties by block).
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0))
    b = blocks.where((some("original_companies") > 1) & (some("resolved_companies") == 1)).select("block_id", "original_companies", F.get("resolved_companies", F.lit(0)).alias("r"))
    b = b.where(F.forall("original_companies", lambda c: c["id"].isNotNull() & c["uuid"].isNotNull()) & F.col("r.uuid").isNotNull())
    empty = F.array().cast("array<string>")
    lineage = F.array_sort(F.array_distinct(F.concat(F.col("original_companies.uuid"), F.flatten(F.transform("original_companies", lambda c: F.coalesce(c["source_uuids"], empty))))))
    companies = F.array_sort(F.transform("original_companies", lambda c: F.struct(c["id"].alias("id"), c["uuid"].alias("uuid"), F.coalesce(c["source_uuids"], empty).alias("source_uuids"))))
    out = b.select("block_id", companies.alias("companies"), F.struct(F.array_min(F.col("original_companies.id")).alias("id"), F.array_compact(lineage).alias("source_uuids")).alias("merged"))
    return out.orderBy(F.size("companies"), "block_id").limit(limit)
