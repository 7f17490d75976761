"""Streaming forms: articles seen once, upserts of the newest version, windowed rates with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strandwerk.operators.dedup import newest


def seen_once(stream: DataFrame, key: str = "url", time: str = "collected_at", delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(start, by, rows)``: rows of each window and value; later rows than the delay are dropped."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("rows"))
    return w.select(F.col("w.start").alias("start"), by, "rows")


#: Buckets of keys of an upserted table; a micro-batch writes only those it touches.
BUCKETS = 64


def _folders(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each bucket of an upserted table, of versions before a given one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_bucket=*")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    newest_of: dict[int, tuple[int, str]] = {}
    for f in found:
        folder = f.getPath()
        version, bucket = int(folder.getParent().getName()[1:]), int(folder.getName().partition("=")[2])
        if before is None or version < before:
            newest_of[bucket] = max(newest_of.get(bucket, (-1, "")), (version, folder.toString()))
    return {b: f for b, (_, f) in newest_of.items()}


def read_upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``upsert_newest`` keeps: the newest version of every bucket."""
    folders = sorted(_folders(spark, path).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_newest(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, seq: str) -> StreamingQuery:
    """Keeps at ``path`` the newest row of each key; read it by ``read_upserted``.

    Keys lie in BUCKETS; micro-batch n writes new versions, below ``v<n>``, of the buckets that it touches, and reads
    no others.  A batch that runs again overwrites only its own version.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        touched = {r.b for r in batch.select(bucket.alias("b")).distinct().collect()}
        old = [f for b, f in _folders(spark, path, n).items() if b in touched]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        newest(rows, key, time, seq).withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v{n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
