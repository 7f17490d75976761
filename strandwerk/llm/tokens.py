"""Encoding of the whole corpus with a byte-level BPE vocabulary, by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can be the last of the prefix's encoding: the token that is the
whole prefix, or else the one whose pair with the last token before it is stable (encoding the two tokens' bytes
gives the two tokens back).  Storing that token for each prefix takes time linear in the piece, gives the encoding by
walking back, allows exact appends, and after an edit only needs the prefixes behind it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose encoding a worker remembers.
CACHE = 400_000
#: A vocabulary file of more bytes is refused, as each worker holds it.
MAX_FILE = 64 << 20


def default_path() -> str:
    """Where the public vocabulary lies: the installed package of vocabularies, or /opt/tokenizers."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Vocabulary:
    """Byte strings by rank, with the test of stable pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})

    def merge(self, b: bytes) -> list[int]:
        """The encoding by repeated merging of the pair of least rank; only for short strings."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            rank, i = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a`` in an encoding."""
        got = self._pairs.get((a, b))
        if got is None:
            got = self._pairs[a, b] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return got

    def whole(self, t: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        got = self._whole.get(t)
        if got is None:
            got = self._whole[t] = self.merge(self.text[t]) == [t]
        return got


class Prefixes:
    """The last token of each prefix of a byte string; grows by ``append``, changes by ``splice``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        self.data += more
        v, data, last, ranks = self.v, self.data, self.last, self.v.ranks
        for end in range(len(last), len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                t = ranks.get(data[start:end])
                if t is not None and (v.stable(last[start], t) if start else v.whole(t)):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
        return self

    def splice(self, start: int, end: int, new: bytes) -> Prefixes:
        """Replace ``data[start:end]``; the prefixes before stay, those behind are taken over again once the last
        tokens agree for as many bytes as the longest token has."""
        tail, old = self.data[end:], self.last[end + 1 :]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        same = 0
        for i in range(len(tail)):
            if same >= self.v.longest:
                self.data += tail[i:]
                self.last += old[i:]
                break
            self.append(tail[i : i + 1])
            same = same + 1 if self.last[-1] == old[i] else 0
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.text[out[-1]])
        return out[::-1]


class Encoder(dict):
    """Pieces (text) to token ids, remembered; ``encode`` gives the ids of a text."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        import regex

        super().__init__()
        self.v, self.pieces = vocabulary, regex.compile(pattern).findall

    def __missing__(self, piece: str) -> list[int]:
        b = piece.encode()
        t = self.v.ranks.get(b)
        ids = [t] if t is not None and self.v.whole(t) else Prefixes(self.v, b).ids()
        if len(self) < CACHE and len(b) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids without special tokens; NULL and '' have none."""
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []


_HELD: dict[str, Encoder] = {}


def _encoder(name: str, data: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary, kept by the worker over its tasks; one vocabulary at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Encoder(Vocabulary.parse(data), pattern)
    return _HELD[name]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(key, ids)``: the token ids of each text, one row for each row of ``df``.

    NULL and empty texts give an empty list; texts of any length are encoded whole, in linear time; special tokens'
    names in a text are ordinary text.  One pass without a shuffle; the vocabulary is broadcast (MAX_FILE bytes).
    """
    import pyarrow as pa

    with open(path or default_path(), "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"a vocabulary of more than {MAX_FILE} bytes")
    shared = df.sparkSession.sparkContext.broadcast(data)
    schema = df.select(key).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = _encoder(shared_id, shared.value, pattern)
        for batch in batches:
            lists = [encoder.encode(s.as_py()) for s in batch.column(1)]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    shared_id = md5(data + pattern.encode()).hexdigest()
    return df.select(key, text).mapInArrow(run, schema)
