"""Keyed de-duplication and incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwerk.session import Cut


def newest(df: DataFrame, key: str, time: str, seq: str) -> DataFrame:
    """One row a key: the newest by ``time`` (missing is oldest), of equal ones the first by ``seq``; rows without a key all stay.

    One aggregation with map-side combine, so that a key with a third of the rows is no burden.
    """
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(time).isNotNull(), F.coalesce(F.col(time).cast("string"), F.lit("")), -F.col(seq))).alias("r"))
    return best.select("r.*").unionByName(df.where(F.col(key).isNull()))


def first_seen(df: DataFrame, key: str, seq: str, last: bool = False) -> DataFrame:
    """One row a key, the first by ``seq`` (or the last); rows without a key are dropped."""
    pick = F.max_by if last else F.min_by
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick(F.struct(*df.columns), seq).alias("r")).select("r.*")


def not_known(new: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """The rows whose key is not known yet, for an append; a NULL key is never known."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)``: the most frequent value; of equally frequent ones the longest, then the greatest; NULLs don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", F.length(F.col(value).cast("string")), value)).alias(value))


def newest_batches(df: DataFrame, time: str, seq: str, size: int = 100) -> DataFrame:
    """``df`` with ``batch``, from 1: batches of ``size`` rows, the newest first by ``time`` (missing last), then by ``seq``.

    Rows are sorted once by ranges; each range is numbered by itself and moved by the rows of the ranges before.
    """
    parts = df.orderBy(F.col(time).desc_nulls_last(), seq).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
    cut = Cut(df.sparkSession, "batches")
    parts = cut.write(parts)
    own = Window.partitionBy("_p").orderBy("_m")
    before = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    n = parts.join(F.broadcast(before), "_p").withColumn("_i", F.row_number().over(own) + F.col("_b"))
    return n.withColumn("batch", (F.floor((F.col("_i") - 1) / size) + 1).cast("bigint")).drop("_p", "_m", "_i", "_b")
