"""Connected components of a distributed table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import land


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).where(F.col("b") != F.col("least"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, root)``: every node that has a link, with the smallest node it reaches.

    Each round is written to the shared folder. Nothing but a count and a checksum comes to the driver; rounds
    grow with the logarithm of the components' diameter. Null ends and links of a node to itself are dropped."""
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = land(ordered)
    state = _state(now)
    while state[0]:
        following = land(_small_star(land(_large_star(now))))
        reached = _state(following)
        now, done = following, reached == state
        state = reached
        if done:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
