"""The query catalogue: name -> Spark query and, where SQL can say it, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = lambda spark, folder: run(prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add
