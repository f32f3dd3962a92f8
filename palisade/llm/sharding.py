"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's shard is the last point of its jump sequence below the number of shards; the sequence depends on
the key alone, so one more shard takes rows only into itself. Rules for odd input: a null key is the key 0;
a null text has no bytes; equal rows stay and get a slot each; an empty table gives an empty table; extra
columns of the input are not touched, because only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import let
from palisade.session import land

# The multiplier of the published jump hash, in 32-bit halves; its scale; bytes a row has beside its text.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
SCALE = 2147483648.0
ROW_BYTES = 16
#: Jumps taken before a row is asked whether it needs more; a key needs about ln(shards) of them.
FIRST_JUMPS = 32
_LOW16, _LOW32 = 0xFFFF, 0xFFFFFFFF


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask).cast("long"))


def _low_product(a: Column, b: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, in steps that stay within 63 bits."""
    low, high = _and(a, _LOW16), F.shiftrightunsigned(a, 16)
    return _and(low * b + F.shiftleft(_and(high * b, _LOW16), 16), _LOW32)


def next_key(key: Column) -> Column:
    """``key * multiplier + 1`` modulo 2**64; ANSI arithmetic would refuse the overflow, so it goes by halves."""
    low, high = _and(key, _LOW32), F.shiftrightunsigned(key, 32)
    first, second = _and(low, _LOW16) * MULTIPLIER_LOW, F.shiftrightunsigned(low, 16) * MULTIPLIER_LOW
    total = _and(first, _LOW32) + F.shiftleft(_and(second, _LOW16), 16) + 1
    carry = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(total, 32)
    upper = _and(carry + _low_product(low, MULTIPLIER_HIGH) + _low_product(high, MULTIPLIER_LOW), _LOW32)
    return F.shiftleft(upper, 32).bitwiseOR(_and(total, _LOW32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to ``shards`` - 1; as the published algorithm with 64-bit wrap-around."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def jump(state: Column) -> Column:
        """state: bucket so far, next bucket, key; stays as it is once the next bucket is out of range."""
        moved = let(next_key(state.key), lambda k: F.struct(
            state.next.alias("bucket"),
            ((state.next + 1).cast("double") * (F.lit(SCALE) / (F.shiftrightunsigned(k, 33) + 1).cast("double"))).cast("long").alias("next"),
            k.alias("key")))
        return F.when(state.next >= shards, state).otherwise(moved)

    start = F.struct(F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"),
                     F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"))

    def jumps(state: Column, count: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(count)), state, lambda acc, _: jump(acc))

    reached = jumps(start, min(FIRST_JUMPS, shards))
    if shards > FIRST_JUMPS:  # a jump goes up by one at least, so ``shards`` jumps always suffice
        reached = let(reached, lambda s: F.when(s.next >= shards, s).otherwise(jumps(s, shards - FIRST_JUMPS)))
    return reached.bucket.cast("int")


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard, the shard it has with one shard more, and its slot in the shard.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Slots count from 0 without gaps in the
    order of key (nulls first), checksum, size. The narrow rows are written first, then dealt in ranges of that order:
    no task holds a whole shard, and equal keys are told apart by a row number, so a key with a third of all
    rows is split as well. Only a count per range and shard is ever brought together.
    """
    narrow = land(rows.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    ))
    order = ["shard", "doc_id", "text_crc32", "size", "row"]
    dealt = land(narrow.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ranges = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("rows")).select(
        F.col("shard").alias("at_shard"), F.col("part").alias("at_part"),
        F.coalesce(F.sum("rows").over(ranges), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order[1:])))
    joined = numbered.join(offsets, (F.col("shard") == F.col("at_shard")) & (F.col("part") == F.col("at_part")))
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")


def oracle(shards: int) -> str:
    """The same over ``documents`` as DuckDB SQL."""
    return f"""
WITH RECURSIVE jumps(doc_id, bucket, following, state) AS (
  SELECT DISTINCT doc_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT),
    CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END
  FROM documents
  UNION ALL
  SELECT doc_id, following, CAST(floor((following + 1) * (2147483648::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT), k
  FROM (SELECT doc_id, following, (state * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE following < {shards + 1})),
placed AS (SELECT doc_id, max(bucket) FILTER (bucket < {shards}) AS shard, max(bucket) AS grown_shard FROM jumps WHERE bucket >= 0 GROUP BY doc_id),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
bytes AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
sums AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, bits)
SELECT s.doc_id, CAST(n + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY s.doc_id NULLS FIRST, crc, n) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""
