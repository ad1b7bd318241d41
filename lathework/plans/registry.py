"""The registered queries: a Spark function and, where one can be written, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathework.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, folder: str, name: str, costly: bool = False) -> DataFrame:
    """One of the given tables; ``costly`` work on its rows is spread over all cores."""
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan) if costly else scan
