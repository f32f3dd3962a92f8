"""First-seen analysis without ordering whole histories.

The first event of every (owner, item) pair is a partial aggregate. Whether a pair was new
*after* its owner already knew enough items only needs the owner's k-th earliest pair, and
"the k-th smallest per owner" is a ranked filter Spark prunes before its shuffle. A pairs table
is also what a baseline stores: daily runs merge their pairs into it and carry on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.joins import lookup_join

ORDER = ["timestamp", "eventId"]


def first_pairs(events: DataFrame, owner: str, item: str, carry: list[str]) -> DataFrame:
    """One row per (owner, item): ``first`` = the earliest event's order and ``carry`` columns."""
    kept = [*ORDER, *[c for c in carry if c not in ORDER]]
    return events.groupBy(owner, item).agg(F.min(F.struct(*kept)).alias("first"), F.count("*").alias("n_events"))


def merge_pairs(stored: DataFrame, fresh: DataFrame, owner: str, item: str) -> DataFrame:
    """Stored baseline plus newly seen pairs: earliest first, summed counts."""
    return (
        stored.unionByName(fresh)
        .groupBy(owner, item)
        .agg(F.min("first").alias("first"), F.sum("n_events").alias("n_events"))
    )


def kth_first(pairs: DataFrame, owner: str, k: int) -> DataFrame:
    """(owner, kth): when the owner got to know its k-th distinct item."""
    earliest = Window.partitionBy(owner).orderBy(*[F.col(f"first.{c}") for c in ORDER])
    return (
        pairs.select(owner, F.struct(*[F.col(f"first.{c}") for c in ORDER]).alias("first"))
        .withColumn("rank", F.row_number().over(earliest))
        .where(F.col("rank") == k)
        .select(owner, F.col("first").alias("kth"))
    )


def newcomers(pairs: DataFrame, owner: str, item: str, known: int) -> DataFrame:
    """Pairs first seen when their owner already knew at least ``known`` other items."""
    joined = lookup_join(pairs, kth_first(pairs, owner, known), [owner],
                         how="inner", measure=False)
    return joined.where(F.struct(*[F.col(f"first.{c}") for c in ORDER]) > F.col("kth")).drop("kth")


def unseen_lookups(events: DataFrame, pairs: DataFrame, owner: str, item: str, known: int) -> DataFrame:
    """Events that read a baseline they do not update: owner knew ``known`` items, not this one."""
    moment = F.struct(*ORDER)
    experienced = lookup_join(events, kth_first(pairs, owner, known), [owner],
                              how="inner", measure=False).where(F.col("kth") < moment).drop("kth")
    seen = pairs.select(owner, item, F.struct(*[F.col(f"first.{c}") for c in ORDER]).alias("seen"))
    joined = lookup_join(experienced, seen, [owner, item], how="left", measure=False)
    return joined.where(F.col("seen").isNull() | (F.col("seen") >= moment)).drop("seen")
