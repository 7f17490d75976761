"""The key/value query language: filters as nested dictionaries, sorting, pages; the split UDTF's SQL surface."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMPARE = {"EQ": "__eq__", "NEQ": "__ne__", "GT": "__gt__", "GTE": "__ge__", "LT": "__lt__", "LTE": "__le__"}


def condition(query: dict) -> Column:
    """A filter such as ``{"AND": [{"EQ": {"state": "x"}}, {"IN": {"n": [1, 2]}}]}`` as a column; an empty one is true."""
    parts = []
    for op, arg in query.items():
        if op in ("AND", "OR"):
            inner = [condition(q) for q in arg]
            c = F.lit(op == "AND")
            for i in inner:
                c = c & i if op == "AND" else c | i
            parts.append(c)
        elif op == "IN":
            parts += [F.col(k).isin(*v) for k, v in arg.items()]
        elif op in _COMPARE:
            parts += [getattr(F.col(k), _COMPARE[op])(v) for k, v in arg.items()]
        else:
            raise ValueError(f"unknown operator {op}")
    c = F.lit(True)
    for p in parts:
        c = c & p
    return c


def run_query(df: DataFrame, query: dict | None = None, sort: list[tuple[str, str]] | None = None, limit: int | None = None, token: int = 0) -> DataFrame:
    """The rows of a page: filtered, sorted by ``(column, 'ASC' | 'DESC')``, ``limit`` rows from offset ``token``."""
    out = df.where(condition(query or {}))
    if sort:
        out = out.orderBy(*[F.desc(c) if d.upper() == "DESC" else F.asc(c) for c, d in sort])
    out = out.offset(token) if token else out
    return out.limit(limit) if limit is not None else out


class SplitLargeBlocks:
    """The handler of the table function ``split_large_blocks(key, type, uuids, max)``."""

    def eval(self, block_key: str, block_key_type: str, uuids: list[str], max_size: int) -> Iterator[tuple[str, str, list[str], int]]:
        uuids = uuids or []
        if len(uuids) <= max_size:
            yield block_key, block_key_type, uuids, len(uuids)
        else:
            for i in range(0, len(uuids), max_size):
                part = uuids[i : i + max_size]
                yield f"{block_key}_chunk_{i // max_size + 1}", block_key_type, part, len(part)


def register(spark: SparkSession) -> None:
    """Registers ``split_large_blocks`` for SQL's LATERAL; ``blocking.split_blocks`` is the native form."""
    spark.udtf.register("split_large_blocks", F.udtf(SplitLargeBlocks, returnType="block_key string, block_key_type string, uuids array<string>, block_size int"))
