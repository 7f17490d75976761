"""Writers: Parquet, JSON lines with null fields, CSV, appends that skip what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.operators.dedup import not_known


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, single: bool = False) -> None:
    """Overwrite; partitioned by columns, or as a single file if asked for (small results only)."""
    w = (df.coalesce(1) if single else df).write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str, nulls: bool = True) -> None:
    """Overwrite as JSON lines; null fields are kept if ``nulls``."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str = "url") -> None:
    """Append to a Parquet table the rows whose key it doesn't have; the table is made if it is missing."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        df = not_known(df, spark.read.schema(df.schema).parquet(path), key)
    df.write.mode("append").parquet(path)


def empty_lists(df: DataFrame) -> DataFrame:
    """NULL lists as empty lists, for readers that can't tell."""
    return df.select(*[F.coalesce(f"`{f.name}`", F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema.fields])


def graph_csv(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """``nodes(id, name, ticker)`` and ``edges(src, dst, relationship)`` as CSV, one folder a relationship with _from and _to."""
    write_csv(nodes.select("id", "name", "ticker"), f"{folder}/nodes")
    edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "relationship").write.mode("overwrite").option("header", True).partitionBy("relationship").csv(f"{folder}/edges")
