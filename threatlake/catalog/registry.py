"""Collects named queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")
            self.queries[name] = fn
            if oracle:
                self.oracles[name] = oracle
            return fn

        return add


def as_long(df: DataFrame) -> DataFrame:
    """Widen int columns, so both engines report the same integer type."""
    return df.select(
        *[F.col(f.name).cast("bigint") if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields]
    )
