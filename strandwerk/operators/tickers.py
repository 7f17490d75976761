"""Matching companies to listed securities by name or by vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwerk.functions.names import match_key
from strandwerk.operators.joins import lookup

#: Securities or query vectors that a task holds at a time; more are taken in blocks.
BLOCK = 20_000


def similarity(a: Column, b: Column) -> Column:
    """100 x (1 - edit distance / longer length)."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / n))


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by one addition of bit vectors a letter."""
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 by insertions and deletions: 200 x common subsequence / both lengths, to six places."""
    return round(200 * common(a, b) / (len(a) + len(b)), 6) if a or b else 100.0


class Best:
    """The best match by ``ratio`` among a list of keys, found without comparing a query with each of them.

    Two texts have no more in common than letters of a kind in both, which bounds every key's ratio at once; keys are
    compared in the order of their bounds until no bound reaches the best ratio.
    """

    def __init__(self, keys: list[str], labels: list[str]):
        order = sorted(range(len(keys)), key=lambda i: (labels[i], keys[i]))
        self.keys, self.labels = [keys[i] for i in order], [labels[i] for i in order]
        letters = sorted({c for k in keys for c in k})
        self.place = {c: i for i, c in enumerate(letters)}
        self.counts = np.zeros((len(letters), len(keys)), np.int16)
        for j, k in enumerate(self.keys):
            for c in k:
                self.counts[self.place[c], j] += 1
        self.sizes = np.array([len(k) for k in self.keys])

    def find(self, query: str) -> tuple[str, float] | None:
        """The label of least order among those of the greatest ratio, and the ratio; None without keys."""
        if not self.keys:
            return None
        held: dict[str, int] = {}
        for c in query:
            held[c] = held.get(c, 0) + 1
        shared = np.zeros(len(self.keys), np.int64)
        for c, n in held.items():
            if c in self.place:
                shared += np.minimum(self.counts[self.place[c]], n)
        bounds = np.round(200 * shared / np.maximum(self.sizes + len(query), 1), 6)
        best, found = -1.0, -1
        for j in np.argsort(-bounds, kind="stable"):
            if bounds[j] < best:
                break
            r = ratio(query, self.keys[j])
            if r > best or (r == best and j < found):
                best, found = r, int(j)
        return self.labels[found], best


def exact_matches(companies: DataFrame, listed: DataFrame) -> DataFrame:
    """``(uuid, ticker, score)`` of equal match keys; of several securities the one of the least ticker."""
    l = listed.select(match_key(F.col("title")).alias("k"), "ticker").where("k <> '' AND ticker IS NOT NULL").groupBy("k").agg(F.min("ticker").alias("ticker"))
    c = companies.select("uuid", match_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    return c.join(l, "k").select("uuid", "ticker", F.lit(100.0).alias("score"))


def best_fuzzy(queries: DataFrame, listed: DataFrame) -> DataFrame:
    """``(name, ticker, score)``: for each distinct query name the security of the greatest ``ratio``, ties by ticker.

    A stated query set against all securities, which are held by the tasks in blocks of BLOCK; each name keeps its
    best, so that no pair is shuffled.  Names without letters or digits have no match; without securities none has.
    """
    import pyarrow as pa

    l = listed.select(match_key(F.col("title")).alias("k"), "ticker").where("k <> '' AND ticker IS NOT NULL").distinct()
    q = queries.select("name", match_key(F.col("name")).alias("q")).where("q <> ''").distinct()
    blocks = -(-l.count() // BLOCK)
    # names are few bytes but much work: they must not be coalesced into few tasks
    spark = q.sparkSession
    q = q.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    out = None
    for i in range(max(blocks, 1)):
        rows = l.where(F.pmod(F.xxhash64("k", "ticker"), F.lit(max(blocks, 1))) == i).collect()
        shared = spark.sparkContext.broadcast(([r.k for r in rows], [r.ticker for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value)
            for batch in batches:
                found = [best.find(x) for x in batch.column(1).to_pylist()]
                keep = pa.array([x is not None for x in found])
                found = [x for x in found if x is not None]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["name", "ticker", "score"])

        part = q.mapInArrow(run, "name string, ticker string, score double")
        out = part if out is None else out.unionByName(part)
    if blocks < 2:
        return out
    return out.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "ticker")).alias("m")).select("name", "m.ticker", (-F.col("m.s")).alias("score"))


def cosine_best(queries: DataFrame, corpus: DataFrame, threshold: float = 0.85, id_col: str = "vec_id", vec: str = "embedding", apart: bool = False) -> DataFrame:
    """``(id, match_id, score)``: for each query vector the corpus vector of the greatest cosine, if it reaches the threshold.

    Unit vectors are assumed; rows without a vector are left out.  A stated query set, taken in blocks of BLOCK,
    against the whole corpus: a task multiplies its vectors with the block's and keeps the best for each query, so
    that at most one row a task and query is shuffled.  ``apart``: a row isn't its own match, for queries that are
    rows of the corpus.
    """
    import pyarrow as pa

    q = queries.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    c = corpus.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    blocks = max(1, -(-q.count() // BLOCK))
    out = None
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        shared = q.sparkSession.sparkContext.broadcast((np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, v = shared.value
            best, match = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
            for batch in batches if len(ids) else ():
                own = batch.column(0).to_numpy()
                order = np.argsort(own, kind="stable")
                own, m = own[order], batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)[order]
                for a in range(0, len(ids), 1024):
                    s = np.round(v[a : a + 1024] @ m.T, 6)
                    if apart:
                        s[ids[a : a + 1024, None] == own] = -np.inf
                    j = s.argmax(1)
                    top, who = s[np.arange(len(j)), j], own[j]
                    better = (top > best[a : a + 1024]) | ((top == best[a : a + 1024]) & (who < match[a : a + 1024]))
                    best[a : a + 1024][better], match[a : a + 1024][better] = top[better], who[better]
            ok = best >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(match[ok]), pa.array(best[ok])], names=["id", "match_id", "score"])

        part = c.mapInArrow(run, "id bigint, match_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "match_id")).alias("b"))
    return best.select("id", F.col("b.match_id").alias("match_id"), (-F.col("b.s")).alias("score"))


def fill_tickers(companies: DataFrame, listed: DataFrame) -> DataFrame:
    """``companies`` with missing tickers filled by exact matches only."""
    m = exact_matches(companies, listed).groupBy("uuid").agg(F.min("ticker").alias("_t"))
    return companies.join(lookup(m), "uuid", "left").withColumn("ticker", F.coalesce("ticker", "_t")).drop("_t")
