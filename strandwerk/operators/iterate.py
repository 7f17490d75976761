"""Rounds of blocking and matching until nothing merges any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.operators import blocking, matching
from strandwerk.session import Cut


def one_each(df: DataFrame, key: str = "uuid") -> DataFrame:
    """One row for each key, the least of its rows, so that the pick doesn't depend on their order."""
    return df.groupBy(key).agg(F.min(F.struct(*df.columns)).alias("r")).select("r.*")


def resolve(companies: DataFrame, max_size: int = 50, rounds: int = 5, matcher: matching.Matcher = matching.same_name) -> DataFrame:
    """``companies(uuid, id, name, ..., source_uuids)`` resolved: block by name, merge each block, repeat on the result.

    A company stands in up to two blocks; of its copies the one of the larger lineage is taken on.  A round's table
    is written to the shared folder, so that plans stay short.  Every input uuid is in the lineage of some output.
    """
    cut = Cut(companies.sparkSession, "resolve")
    cols = [c for c in companies.columns if c not in ("uuid", "source_uuids")]
    now = cut.write(companies.withColumn("source_uuids", matching.append_once(F.col("source_uuids"), F.col("uuid"))))
    n = now.count()
    for i in range(1, rounds + 1):
        keys = blocking.name_keys(now)
        members = blocking.assign_blocks(keys, max_size).select("block_key", "uuid").join(one_each(now), "uuid")
        rest = now.join(keys, "uuid", "left_anti")
        merged = matching.merge_members(members, i, matcher)
        pick = [c for c in cols if c in merged.columns]
        merged = merged.select("uuid", *pick, "source_uuids")
        # an entry whose records are all in another, larger entry adds nothing
        uses = merged.select("uuid", F.size("source_uuids").alias("n"), F.explode("source_uuids").alias("s"))
        best = uses.groupBy("s").agg(F.min_by("uuid", F.struct(-F.col("n"), F.col("uuid"))).alias("uuid"))
        keep = one_each(merged).join(best, "uuid", "left_semi")
        new = cut.write(keep.unionByName(rest.select("uuid", *pick, "source_uuids")))
        m = new.count()
        cut.free(now)
        now = new
        if m == n:
            break
        n = m
    return now
