"""Abusive, hateful or sexual content: a factorization machine over hashed terms of passages.

A document is as toxic as its worst passage (a sentence, or a window of a long one).  The machine scores a passage by
a bias, a weight for each term and an inner product for each pair of terms, so that a group's name beside an insult
counts for what neither does alone.  All it knows of words it learns from the labels; no list of words stands behind it.

The labels speak of documents, not of passages, and some are wrong.  So the fitting is crossed: in each round, FOLDS
machines are fitted, each without one fold of the documents, and score that fold.  The passage of a positive document
that the machine which hasn't seen it finds worst stands for the document; a positive document in which that machine
finds nothing suspicious, and a negative one that it is sure of, count as wrongly labelled.  The held-out scores also
give the threshold.  The folds are fitted by as many tasks; all documents are scored, whole, in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwerk.llm.plain import plain

#: Labelled documents the machine is fitted on, at most; of more, those of least hash.
LABELLED = 12_000
#: Bits of a term's hash; labelled documents that a term must occur in to be learnt.
BITS, LEAST_DOCS = 22, 3
#: Words of a passage at most; longer sentences are cut into windows that overlap by half.
WINDOW = 16
FACTORS, FOLDS, EPOCHS, RATE, DECAY, BATCH = 8, 5, (4, 6, 8), 0.1, 2e-6, 256
#: A positive document whose worst passage scores below WRONG, a negative one above 1 - WRONG, is taken as wrongly labelled.
WRONG = 0.1
#: Scores are calibrated so that this is the threshold of greatest F1 on held-out documents.
THRESHOLD = 0.5

_SPLIT = re.compile(r"(?<=[.!?])[\s\"')]+|[\n\r\t\x0b\x0c]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_](?:[ .\-_*]{1,3}|  +)){2,}[^\W_](?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[\w@$!|*'’]*[\w*])?|[@$][\w@$!|*]+\w")
_LEET = str.maketrans("013457@$!|", "oieastasii")
_RUN = re.compile(r"(.)\1+")
#: Entries of a worker's memory of tokens.
_MEMORY = 500_000


def _joined(m: re.Match) -> str:
    s = re.sub(r"[\W_]+", "", m[0])
    return s if len(s) > 2 else m[0]


def term(token: str) -> str:
    """A word with its disguises undone: letters for signs, single for repeated ones; numbers alike; a mask by its ends."""
    if token[0].isdigit() and not any(c.isalpha() for c in token):
        return "#"
    if "*" in token:
        return f"*{token[0]}{token[-1]}"
    t = token.replace("'", "").replace("’", "")
    if not t.isalpha():
        t = t.translate(_LEET)
    w = _RUN.sub(r"\1", t)
    return w if len(w) > 2 else t


def passages(text: str, known: Coder) -> list[list[int]]:
    """The passages of a text as lists of the codes of different terms: sentences, or windows of WINDOW words of longer ones."""
    out = []
    for s in _SPLIT.split(plain(text)):
        ts = [known[t] for t in _TOKEN.findall(_SPACED.sub(_joined, s))] if s else ()
        if ts:
            last = max(1, len(ts) - WINDOW // 2) if len(ts) > WINDOW else 1
            out += [list(dict.fromkeys(ts[at : at + WINDOW])) for at in range(0, last, WINDOW // 2)]
    return out


def code(t: str) -> int:
    """The hash of a term, above 0."""
    h = 2166136261
    for b in t.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return 1 + (h ^ (h >> 15)) % ((1 << BITS) - 1)


class Coder(dict):
    """Words to the rows of their terms in a machine (0: not learnt), or to the terms' hashes."""

    def __init__(self, codes: np.ndarray | None = None):
        super().__init__()
        self.rows = None if codes is None else {int(c): i + 1 for i, c in enumerate(codes)}

    def __missing__(self, word: str) -> int:
        c = code(term(word))
        c = c if self.rows is None else self.rows.get(c, 0)
        if len(self) < _MEMORY:
            self[word] = c
        return c


def matrix(units: list[list[int]]) -> np.ndarray:
    """Passages as rows of codes, filled up with 0."""
    x = np.zeros((len(units), WINDOW), np.int32)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    x[np.arange(WINDOW) < sizes[:, None]] = np.fromiter((c for u in units for c in u), np.int32)
    return x


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -30, 30)))


class Machine:
    """A factorization machine with logistic loss, fitted by Adagrad on passages; row 0 of its tables is no term."""

    def __init__(self, terms: int, seed: int = 7):
        self.b = np.float32(-4)
        self.w = np.zeros(terms + 1, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (terms + 1, FACTORS)).astype(np.float32)
        self.v[0] = 0

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.v[x]
        s = v.sum(1)
        return self.b + self.w[x].sum(1) + 0.5 * ((s * s).sum(1) - np.einsum("ijk,ijk->i", v, v)), v, s

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of each passage."""
        return np.concatenate([np.zeros(0), *[_sigmoid(self.raw(x[i : i + 8192])[0]) for i in range(0, len(x), 8192)]])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 11) -> Machine:
        rng, n = np.random.default_rng(seed), len(self.w)
        past_b, past_w, past_v = 1e-2, np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                i = order[at : at + BATCH]
                xi = x[i]
                raw, v, s = self.raw(xi)
                g = (_sigmoid(raw) - y[i]).astype(np.float32)
                ids, where = np.unique(xi, return_inverse=True)
                where = where.ravel()
                gw = np.bincount(where, np.repeat(g, WINDOW), len(ids)).astype(np.float32) + DECAY * len(i) * self.w[ids]
                each = (g[:, None, None] * (s[:, None, :] - v)).reshape(-1, FACTORS)
                gv = np.stack([np.bincount(where, each[:, k], len(ids)) for k in range(FACTORS)], 1).astype(np.float32) + 10 * DECAY * len(i) * self.v[ids]
                past_w[ids] += gw * gw
                past_v[ids] += gv * gv
                self.w[ids] -= RATE * gw / np.sqrt(past_w[ids])
                self.v[ids] -= RATE * gv / np.sqrt(past_v[ids])
                self.w[0], self.v[0] = 0, 0
                gb = float(g.sum())
                past_b += gb * gb
                self.b -= np.float32(RATE * gb / past_b**0.5)
        return self


class Sample:
    """Labelled documents as passages: codes learnt, rows of codes, each row's document, labels and folds of the documents."""

    def __init__(self, docs: list[np.ndarray], labels: list[float], folds: list[int]):
        self.y, self.fold = np.array(labels, np.float32), np.array(folds, np.int64) % FOLDS
        self.owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        x = np.concatenate([np.zeros((0, WINDOW), np.int32), *docs])
        # terms of too few documents aren't learnt: names would only be learnt by heart
        ids, at = np.unique(x, return_inverse=True)
        pairs = np.unique(np.repeat(self.owner, WINDOW) * len(ids) + at.ravel())
        kept = (np.bincount(pairs % len(ids), minlength=len(ids)) >= LEAST_DOCS) & (ids > 0) if len(ids) else ids > 0
        self.codes = ids[kept]
        self.x = np.where(kept, np.cumsum(kept), 0).astype(np.int32)[at].reshape(x.shape)

    def usable(self) -> bool:
        return bool((self.y > 0.5).any() and (self.y < 0.5).any() and len(self.codes))

    def first(self) -> np.ndarray:
        """The first guess of passages: the log odds by document of their five terms that tell most."""
        n = len(self.codes) + 1
        pairs = np.unique(np.repeat(self.owner, WINDOW) * n + self.x.ravel())
        hit, t = self.y[pairs // n] > 0.5, pairs % n
        odds = np.log((np.bincount(t[hit], minlength=n) + 0.5) / (self.y > 0.5).sum()) - np.log((np.bincount(t[~hit], minlength=n) + 0.5) / (self.y < 0.5).sum())
        odds[0] = 0
        return _sigmoid(np.sort(odds[self.x], 1)[:, -5:].sum(1) - 6)

    def worst(self, guess: np.ndarray) -> np.ndarray:
        """The greatest guess of each document's passages."""
        best = np.zeros(len(self.y))
        np.maximum.at(best, self.owner, guess)
        return best

    def fit(self, guess: np.ndarray, r: int, without: int | None = None) -> Machine:
        """A machine fitted on all folds but one, with the passages' part told by the guess of round ``r`` before."""
        best, pos = self.worst(guess), self.y > 0.5
        # the first guess comes from the labels themselves and is no evidence against them
        doubt = (np.where(pos, best, 1 - best) < WRONG) & (r > 0)
        fine = ~doubt & (self.fold != (-1 if without is None else without))
        pos = pos[self.owner]
        target = pos & ((guess >= best[self.owner] - 1e-9) | ((guess > 0.5) & (r > 0)))
        use = np.flatnonzero(fine[self.owner] & (target | ~pos))
        return Machine(len(self.codes)).fit(self.x[use], target[use].astype(np.float32), EPOCHS[min(r, len(EPOCHS) - 1)], seed=11 + r)

    def held_out(self, machine: Machine, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of a fold's passages, and their scores by the machine that hasn't seen them."""
        at = np.flatnonzero(self.fold[self.owner] == fold)
        return at, machine.score(self.x[at])

    def threshold(self, guess: np.ndarray) -> float:
        """The threshold of greatest F1 of the held-out scores; of equal ones the nearest to one half."""
        best, pos = self.worst(guess), self.y > 0.5
        grid = np.arange(0.2, 0.81, 0.05)
        f1 = [2 * (pos & (best >= c)).sum() / (pos.sum() + (best >= c).sum()) for c in grid]
        return float(min(zip(grid, f1), key=lambda p: (-round(p[1], 3), abs(p[0] - 0.5)))[0])


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Sample:
    """At most ``limit`` labelled documents with text and the mean of their labels; ties between raters are left out.

    The texts are coded where they lie; the driver gets their codes only.  Copies of a text share a fold.
    """
    import pyarrow as pa

    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y")).where("y <> 0.5")
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # the labels are few and broadcast; only the labelled documents are shuffled
    d = docs.where("text IS NOT NULL").join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Coder()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            x = [matrix(passages(t, known)).tobytes() for t in texts]
            folds = [crc32(" ".join(plain(t).split()).encode()) % FOLDS for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folds, pa.int32()), pa.array(x, pa.binary())], names=["place", "y", "fold", "x"])

    rows = d.select(F.xxhash64("doc_id").alias("place"), "y", "text").mapInArrow(coded, "place bigint, y double, fold int, x binary").orderBy("place", "x").collect()
    return Sample([np.frombuffer(r.x, np.int32).reshape(-1, WINDOW) for r in rows], [r.y for r in rows], [r.fold for r in rows])


def fit(spark: SparkSession, sample: Sample) -> tuple[Machine, np.ndarray]:
    """A machine from labelled documents, calibrated so that THRESHOLD is the best threshold, and the codes of its rows.

    A round's folds are fitted by as many tasks, which hold the sample.  Without documents of both labels the
    machine knows no term and scores everything alike.
    """
    import pyarrow as pa

    if not sample.usable():
        return Machine(0), np.zeros(0, np.int32)
    shared = spark.sparkContext.broadcast(sample)
    guess = sample.first()

    def run(batches: Iterator[pa.RecordBatch], r: int, told) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                machine = shared.value.fit(told.value, r, k if k >= 0 else None)
                at, p = shared.value.held_out(machine, k)
                parts = [at.astype(np.int64), p.astype(np.float64), machine.b.astype(np.float32), machine.w, machine.v]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["at", "p", "b", "w", "v"])

    def fitted(r: int, folds: list[int]) -> list:
        told = spark.sparkContext.broadcast(guess)
        tasks = spark.createDataFrame([(k,) for k in folds], "fold bigint").repartitionByRange(len(folds), "fold")
        return tasks.mapInArrow(lambda batches: run(batches, r, told), "at binary, p binary, b binary, w binary, v binary").collect()

    for r in range(len(EPOCHS)):
        new = np.zeros(len(guess))
        for x in fitted(r, list(range(FOLDS))):
            new[np.frombuffer(x.at, np.int64)] = np.frombuffer(x.p)
        guess = new
    x = fitted(len(EPOCHS), [-1])[0]
    machine = Machine(0)
    machine.w, machine.v = np.frombuffer(x.w, np.float32), np.frombuffer(x.v, np.float32).reshape(-1, FACTORS)
    threshold = sample.threshold(guess)
    machine.b = np.frombuffer(x.b, np.float32)[0] + np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(threshold / (1 - threshold)))
    return machine, sample.codes


def score(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``(doc_id, source, score)``: the probability of each document's worst passage, one row for each row of ``docs``.

    NULL, empty and blank texts score 0.  Without usable labels every other score is the machine's prior.  The
    machine has a row for each term of at least LEAST_DOCS of at most ``limit`` labelled documents, however large the
    corpus; it is broadcast.
    """
    return score_with(docs, *fit(docs.sparkSession, labelled(docs, labels, limit)))


def score_with(docs: DataFrame, machine: Machine, codes: np.ndarray) -> DataFrame:
    """``(doc_id, source, score)`` by a fitted machine; see ``score``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((machine, codes))
    schema = docs.select("doc_id", "source").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value[0], Coder(shared.value[1])
        for batch in batches:
            units, ends = [], [0]
            for t in batch.column(2):
                units += passages(t.as_py() or "", known)
                ends.append(len(units))
            p = m.score(matrix(units))
            best = [float(p[a:b].max()) if b > a else 0.0 for a, b in pairwise(ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.float64())], names=["doc_id", "source", "score"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, documents, toxic, rate)`` of scored documents; NULL is a source of its own."""
    r = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("toxic"))
    return r.select("source", "documents", "toxic", F.round(F.col("toxic") / F.col("documents"), 6).alias("rate"))
