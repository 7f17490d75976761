"""Blocking by vectors: nearest centroid, size-bounded clusters, statistics of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.operators.blocking import numbered

#: Centroids are model parameters: at most so many are broadcast.
MAX_CENTROIDS = 50_000


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``(vec_id, cluster, distance)``: each vector's centroid of least cosine distance (ties: least cluster); farther ones are dropped.

    ``centroids(cluster, centroid)`` are a model of at most MAX_CENTROIDS rows, held by the tasks; a batch of vectors
    meets all of them in one matrix product.  Vectors that are NULL come out nowhere.
    """
    import pyarrow as pa

    rows = centroids.where("cluster IS NOT NULL AND centroid IS NOT NULL").orderBy("cluster").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    v = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    schema = v.select("vec_id").schema.add("cluster", centroids.schema["cluster"].dataType).add("distance", "double")
    shared = v.sparkSession.sparkContext.broadcast(([r.cluster for r in rows], np.array([r.centroid for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for batch in batches if names else ():
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                d = np.round(1 - part.column(1).flatten().to_numpy().reshape(part.num_rows, -1) @ c.T, 6)
                j = d.argmin(1)
                d = d[np.arange(len(j)), j]
                ok = pa.array(d <= (np.inf if max_distance is None else max_distance))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), pa.array([names[x] for x in j]).filter(ok), pa.array(d).filter(ok)], schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    return v.mapInArrow(run, schema)


def kmeans_centroids(vectors: DataFrame, target: int = 50, iteration: int = 1, seed: int = 1, root: bool = False) -> DataFrame:
    """``(cluster, centroid)`` by k-means, for clusters of about ``max(10, target // iteration)`` vectors.

    The centroids are a model: at most MAX_CENTROIDS (``root``: at most the square root of the vectors too), fitted on
    a sample of 64 vectors a centroid, those of least hash.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    k = min(max(1, n // max(10, target // iteration)), MAX_CENTROIDS)
    k = max(1, min(k, int(n**0.5))) if root else k
    share = min(1.0, 64 * k / max(n, 1))
    # hashes are spread evenly, so that a bound on them takes the share without sorting the table
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if k < 2:
        return vectors.select(F.lit(0).alias("cluster"), F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    m = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(m.clusterCenters())], "cluster int, centroid array<double>")


def semantic_blocks(vectors: DataFrame, target: int = 50, iteration: int = 1, max_distance: float | None = None, max_size: int = 1000, root: bool = False) -> DataFrame:
    """``(block_key, vec_id)``: vectors by cluster; those farther than ``max_distance``, or NULL, are alone as ``unblocked_<id>``.

    Clusters of more than ``max_size`` vectors are cut into ``semantic_<n>_chunk_<i>``, so that blocks stay bounded
    however many vectors a centroid draws.
    """
    a = nearest_centroid(vectors, kmeans_centroids(vectors, target, iteration, root=root), max_distance)
    alone = lambda df: df.select(F.concat(F.lit("unblocked_"), F.col("vec_id").cast("string")).alias("block_key"), "vec_id")
    far = alone(vectors.select("vec_id").join(a, "vec_id", "left_anti"))
    n = numbered(a.select("cluster", "vec_id", F.col("vec_id").cast("string").alias("o")), "cluster", "o")
    chunk = F.when(F.col("total") > max_size, F.concat(F.lit("_chunk_"), (F.floor((F.col("pos") - 1) / max_size) + 1).cast("string"))).otherwise("")
    return n.select(F.concat(F.lit("semantic_"), F.col("cluster").cast("string"), chunk).alias("block_key"), "vec_id").unionByName(far)


def distance_stats(assigned: DataFrame) -> DataFrame:
    """One row a cluster: size, min, max, mean, deviation and percentiles of the distances."""
    p = F.percentile("distance", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9, 0.99)]))
    return assigned.groupBy("cluster").agg(
        F.count("*").alias("size"), F.min("distance").alias("min_d"), F.max("distance").alias("max_d"), F.round(F.avg("distance"), 6).alias("mean_d"), F.round(F.stddev_pop("distance"), 6).alias("std_d"),
        F.round(F.get(p, F.lit(0)), 6).alias("p10"), F.round(F.get(p, F.lit(1)), 6).alias("p50"), F.round(F.get(p, F.lit(2)), 6).alias("p90"), F.round(F.get(p, F.lit(3)), 6).alias("p99"),
    )


def name_distance_stats(blocks: DataFrame, members: str = "names") -> DataFrame:
    """``blocks(block_key, names)`` to unique names, exact duplicates, and min, max, mean edit distance of the pairs of different names.

    The pairs are formed inside the block's own row, whose list is bounded by the block size.
    """
    u = F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull())))
    total = F.size(F.filter(members, lambda x: x.isNotNull()))
    pairs = F.flatten(F.transform("u", lambda a, i: F.transform(F.slice("u", i + 2, F.size("u")), lambda b: F.levenshtein(a, b))))
    b = blocks.select("block_key", total.alias("n"), u.alias("u")).withColumn("d", pairs)
    avg = F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return b.select("block_key", F.size("u").cast("bigint").alias("unique_names"), (F.col("n") - F.size("u")).cast("bigint").alias("exact_duplicates"), zero(F.array_min("d")).cast("bigint").alias("min_lev"), zero(F.array_max("d")).cast("bigint").alias("max_lev"), F.round(F.when(F.size("d") > 0, avg).otherwise(F.lit(0.0)), 6).alias("mean_lev"))


def most_diverse(stats: DataFrame, limit: int = 5) -> DataFrame:
    """The blocks of ``name_distance_stats`` with the greatest edit distances, of equal ones those of fewer names (ties by key); blocks of one name are none."""
    return stats.where("unique_names > 1").orderBy(F.desc("max_lev"), "unique_names", "block_key").limit(limit)
