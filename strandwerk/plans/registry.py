"""The registered queries: name to callable, name to oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module; ``add`` is a decorator that takes the oracle SQL, if there is one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def wrap(f: Query) -> Query:
            key = name or f.__name__
            assert key not in self.queries, key
            self.queries[key] = f
            if sql:
                self.oracle[key] = sql
            return f

        return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the data folder ``d``."""
    return spark.read.parquet(f"{d}/{name}.parquet")
