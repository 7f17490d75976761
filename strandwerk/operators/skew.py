"""Per-key results where a few keys hold most records.

Heavy keys are found by a frequent-items sketch over all entries; their blocks are aggregated beside a broadcast of
the heavy keys, salted over many tasks; the remaining keys take the ordinary shuffle; the two results are united.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch; its error is below 3.5 / ITEMS of all entries, so that no key of THETA is missed.
ITEMS = 1024
#: A key is heavy from this share of all entries on.
THETA = 0.02
#: Tasks over which each heavy key is spread.
SALTS = 64


def block_key_of(key: Column) -> Column:
    """A block key in upper case without outer blanks and chunk suffix."""
    return F.regexp_replace(F.upper(F.trim(key)), r"\s*_CHUNK_\d+\s*$", "")


def key_sizes(blocks: DataFrame) -> DataFrame:
    """``(block_key, block_id, entries)``: one row for each block; only the list's uuids are read.

    ``entries`` is what ``original_companies`` holds, whatever ``block_size`` says; NULL lists hold nothing.  Blocks
    without a key stay: their entries count in the total, but they are no key.
    """
    n = F.coalesce(F.size(F.col("original_companies.uuid")), F.lit(0))
    return blocks.select(block_key_of(F.col("block_key")).alias("block_key"), "block_id", F.greatest(n, F.lit(0)).cast("bigint").alias("entries"))


def heavy_candidates(sizes: DataFrame, theta: float = THETA, items: int = ITEMS) -> DataFrame:
    """``(block_key)``: every key with at least ``theta`` of the entries, and perhaps some with a little less.

    A frequent-items sketch of ``items`` counters over one row an entry.  At most 1 / (theta - 3.5 / items) keys
    come out, which bounds the broadcast that uses them.
    """
    k = math.ceil(1 / (theta - 3.5 / items))
    each = sizes.where("entries > 0 AND block_key IS NOT NULL").select(F.explode(F.expr("array_repeat(block_key, cast(entries AS int))")).alias("k"))
    return each.agg(F.expr(f"approx_top_k(k, {min(k, items)}, {items})").alias("top")).select(F.explode("top.item").alias("block_key"))


def _agg(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("blocks"), F.sum("entries").alias("companies"), F.min("entries").alias("min_size"), F.max("entries").alias("max_size"))


def key_results(sizes: DataFrame, theta: float = THETA) -> DataFrame:
    """``(block_key, blocks, companies, min_size, max_size, avg_size, heavy)`` for every key.

    ``heavy`` tells the keys that took the salted path.  An empty table gives an empty table.
    """
    keys = F.broadcast(heavy_candidates(sizes, theta))
    hot = sizes.join(keys, "block_key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("block_id"), F.lit(SALTS)))
    parts = _agg(hot, "block_key", "salt")
    hot = parts.groupBy("block_key").agg(F.sum("blocks").alias("blocks"), F.sum("companies").alias("companies"), F.min("min_size").alias("min_size"), F.max("max_size").alias("max_size")).withColumn("heavy", F.lit(True))
    rest = _agg(sizes.where("block_key IS NOT NULL").join(keys, "block_key", "left_anti"), "block_key").withColumn("heavy", F.lit(False))
    out = hot.unionByName(rest)
    return out.select("block_key", "blocks", "companies", "min_size", "max_size", F.round(F.col("companies") / F.col("blocks"), 6).alias("avg_size"), "heavy")


def heavy_keys(sizes: DataFrame, theta: float = THETA) -> DataFrame:
    """``(block_key)``: the keys whose blocks together hold at least ``theta`` of all entries.

    The sketch names the candidates; their exact counts decide.  Without any entry no key is heavy.
    """
    keys = F.broadcast(heavy_candidates(sizes, theta))
    exact = sizes.join(keys, "block_key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("block_id"), F.lit(SALTS)))
    exact = exact.groupBy("block_key", "salt").agg(F.sum("entries").alias("n")).groupBy("block_key").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("entries")).scalar()
    return exact.where(F.col("n") >= theta * total).select("block_key")
