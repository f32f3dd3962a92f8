"""Look-up joins that stay safe whatever the size of the look-up side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a dimension: reads at most ``max_rows`` + 1 rows of it."""
    size = (
        df.limit(max_rows + 1)
        .select(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("b"))
        .agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
        .first()
    )
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", measure: bool = True) -> DataFrame:
    """Join ``big`` to a look-up on ``on`` (same column names on both sides, one look-up row per key).

    A look-up measured small is broadcast. Otherwise both sides shuffle on the key, and adaptive execution splits
    whatever partition a busy key makes large, into as many pieces as its measured size asks for. ``measure=False``
    skips the measuring job for computed look-ups. The planner takes a few columns of a compressed table for far smaller
    than they are; an inner join may broadcast either side, so there the shuffle is asked for."""
    names = {c: f"__k_{c}" for c in on}
    side = small.withColumnsRenamed(names)
    if measure and fits_broadcast(small):
        side = F.broadcast(side)
    elif measure or how == "inner":
        side = side.hint("merge")
    return big.join(side, _all_equal(on, names), how).drop(*names.values())


def _all_equal(on: list[str], names: dict[str, str]) -> Column:
    condition = None
    for c in on:
        equal = F.col(c) == F.col(names[c])
        condition = equal if condition is None else condition & equal
    return condition
