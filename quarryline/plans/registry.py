"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.sources.tables import table


class Tables:
    """The tables of a data folder as attributes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f"ref_{name}"] = lambda spark, base: f(Tables(spark, base))
            if sql:
                self.sql[f"ref_{name}"] = sql
            return f

        return add
