"""Evaluation texts leaking into training text.

A leak is a run of at least RUN words of an item, in order, of which at most one in SEVENTH is replaced or left out.
Pigeonhole: such a run falls into at most errors + 1 exact parts, so that at least HITS of the item's pieces of PIECE
words occur exactly in the document.  The pieces of all items of a block are looked up by their hashes in one pass over
the document; documents with enough hits of an item are verified by Myers' bit-parallel distance over words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwerk.llm.plain import words

RUN, SEVENTH, PIECE = 20, 7, 4
#: Exact pieces that every leak holds: M words in at most E + 1 parts hold M - (PIECE - 1)(E + 1) pieces; least for 21 words with 3 errors.
HITS = 6
#: Items are a stated query set: they are broadcast in blocks of so many (about 50 MB of pieces in a worker).
BLOCK = 50_000
#: Words whose hashes a worker remembers.
_MEMORY = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_hits() -> int:
    """HITS from its definition, over runs up to 20 times RUN."""
    return min((n - e) - (PIECE - 1) * (e + 1) for n in range(RUN, 20 * RUN) for e in range(n // SEVENTH + 1))


def runs_from(item: list[str], a: int, doc: list[str], j: int) -> bool:
    """Whether a leak starts with ``item[a]`` at ``doc[j]``: some prefix of ``item[a:]`` of at least RUN words, ending in a
    match, has at most a SEVENTH of its words in edit distance to some stretch from ``doc[j]`` on.

    Myers' bit vectors hold the differences down one column of the distance table, so that every prefix's distance
    is two bit counts away.
    """
    rest = item[a:]
    m = len(rest)
    if m < RUN:
        return False
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(rest):
        at[w] |= 1 << i
    full = (1 << m) - 1
    pv, mv = full, 0
    long = full & ~((1 << (RUN - 1)) - 1)
    for col, w in enumerate(doc[j : j + m + m // SEVENTH + 1], 1):
        eq = at.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if not col & 7 and col <= m:
            # a cell in the column's diagonal is at most twice the column's least
            below = (1 << col) - 1
            if col + (pv & below).bit_count() - (mv & below).bit_count() > 2 * (m // SEVENTH):
                return False
        ends = eq & long
        while ends:
            low = ends & -ends
            n = low.bit_length()
            below = (low << 1) - 1
            if SEVENTH * (col + (pv & below).bit_count() - (mv & below).bit_count()) <= n:
                return True
            ends ^= low
    return False


def leaks(item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> bool:
    """Whether the document holds a leak of the item, given its exact pieces as (item position, document position)."""
    # a leak's pieces lie near one diagonal; look for its start at matches that can't be extended to the left
    tried: set[tuple[int, int]] = set()
    reach = len(item) // SEVENTH + 1
    by_doc = sorted((j, i) for i, j in hits)
    # the pieces within the stretch that a run over this piece could cover, counted as the stretch moves on
    near: dict[int, int] = defaultdict(int)
    lo = hi = 0
    for j, i in by_doc:
        while hi < len(by_doc) and by_doc[hi][0] < j + len(item) + reach:
            near[by_doc[hi][1]] += 1
            hi += 1
        while by_doc[lo][0] < j - len(item) - reach:
            near[by_doc[lo][1]] -= 1
            if not near[by_doc[lo][1]]:
                del near[by_doc[lo][1]]
            lo += 1
        if len(near) < HITS:
            continue
        while i and j and item[i - 1] == doc[j - 1]:
            i, j = i - 1, j - 1
        if (i, j) not in tried:
            tried.add((i, j))
            if runs_from(item, i, doc, j):
                return True
    # a run may also begin with matches too short for a piece, at most 2 * reach words before its first piece
    for i, j in sorted(tried):
        for a in range(max(0, i - (PIECE + 1) * reach), i):
            for b in range(max(0, j - (i - a) - reach), min(j, j - (i - a) + reach + 1)):
                if item[a] == doc[b] and not (a and b and item[a - 1] == doc[b - 1]) and (a, b) not in tried:
                    tried.add((a, b))
                    if runs_from(item, a, doc, b):
                        return True
    return False


class Words(dict):
    """Words to their hashes of 64 bits."""

    def __missing__(self, w: str) -> int:
        h = int.from_bytes(blake2b(w.encode(), digest_size=8).digest())
        if len(self) < _MEMORY:
            self[w] = h
        return h

    def pieces(self, ws: list[str]) -> np.ndarray:
        """The hashes of all pieces of PIECE words, by their first word."""
        h = np.fromiter((self[w] for w in ws), np.uint64, len(ws))
        n = max(len(ws) - PIECE + 1, 0)
        out = np.zeros(n, np.uint64)
        for k in range(PIECE):
            out = (out + h[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        return out


class Index:
    """The pieces of a block of items by their hashes; words are compared before anything counts as a leak."""

    def __init__(self, items: list[tuple]):
        self.words = Words()
        self.ids = [i for i, t in items if t]
        self.texts = [words(t) for _, t in items if t]
        self.items = dict(zip(self.ids, self.texts))
        long = [i for i, w in enumerate(self.texts) if len(w) >= RUN]
        each = [self.words.pieces(self.texts[i]) for i in long]
        h = np.concatenate([np.zeros(0, np.uint64), *each])
        item = np.repeat(np.array(long, np.int64), [len(x) for x in each])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in each]])
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.known, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)

    def found(self, text: str) -> list:
        """The ids of the items that leak into a text."""
        doc = words(text)
        if not len(self.known) or len(doc) < RUN - RUN // SEVENTH:
            return []
        h = self.words.pieces(doc)
        where = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        j = np.flatnonzero(self.known[where] == h)
        if len(j) < HITS:
            return []
        # every hit of a piece, with each item that holds it
        n, first = self.count[where[j]], self.start[where[j]]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        item, at, j = self.item[row], self.at[row], np.repeat(j, n)
        longest = int(self.at.max()) + 1
        different = np.unique(item * longest + at) // longest
        ids, counts = np.unique(different, return_counts=True)
        out = []
        for i in ids[counts >= HITS]:
            mine = item == i
            if leaks(self.texts[i], doc, list(zip(at[mine].tolist(), j[mine].tolist()))):
                out.append(self.ids[i])
        return sorted(out)


_HELD: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str]]) -> Index:
    """The index of a block of items, kept by the worker over its tasks; one block at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Index(items)
    return _HELD[name]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item)``: each document with each item it leaks, once; repeated documents' rows count each.

    NULL and empty texts hold no leak, items of fewer than RUN words can't leak; an item id of several texts leaks if
    one of them does.  The documents are read once for each BLOCK of items, without a shuffle; the driver and a worker
    hold one block at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    known = items.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    blocks = max(1, -(-known.count() // BLOCK))
    schema = docs.select(key).schema.add(item, items.schema[item].dataType)
    kind = to_arrow_schema(schema)
    out = None
    for b in range(blocks):
        rows = [(r.i, r.t) for r in known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for batch in batches:
                ids, found = [], []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for i in dict.fromkeys(index.found(t.as_py() or "")):
                        ids.append(d)
                        found.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind.field(0).type), pa.array(found, kind.field(1).type)], schema=kind)

        part = docs.select(key, text).where(f"`{text}` IS NOT NULL").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
