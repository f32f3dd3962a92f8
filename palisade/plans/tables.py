"""The derived input tables, landed once per session the way an event store holds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.session import land
from palisade.sources import adapters

_landed: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _landed:
        _landed[key] = land(build())
    return _landed[key]


def sec_events(spark: SparkSession, folder: str, burst: bool = False) -> DataFrame:
    return _once(spark, folder, f"events-{burst}", lambda: adapters.sec_events(spark, folder, burst))


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "raw", lambda: adapters.raw_records(spark, folder))
