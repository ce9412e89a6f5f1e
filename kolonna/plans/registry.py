"""A registry of named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries named {key}")
            self.queries[key] = f
            if sql:
                self.oracles[key] = sql
            return f

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
