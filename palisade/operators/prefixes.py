"""Address ranges by prefix, for IPv4 and IPv6: a range is at most twice as many prefixes as an address has bits, and an
address looks up one key for each prefix length that occurs.

A prefix is written as its family and its bits, ``4`` or ``6`` in front of zeros and ones, so that looking up is an equality
of strings: however wide a range is, it is a few rows, and nothing compares an address with all ranges.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.text import ipv4_number

_DIGITS = 39  # of 2**128
_GROUPS = 8


def address_bits(ip: Column) -> Column:
    """``4`` and 32 bits or ``6`` and 128 bits; null when it is no address. IPv6 may be shortened, may end in a dotted quad, and
    may be in either case."""
    four = F.concat(F.lit("4"), F.lpad(F.bin(ipv4_number(ip)), 32, "0"))
    text = F.lower(ip)
    quad = F.regexp_extract(text, r"^[0-9a-f:]*:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    number = ipv4_number(quad)
    as_groups = F.concat_ws(":", F.hex(F.shiftright(number, 16)), F.hex(number.bitwiseAND(F.lit(0xFFFF))))
    text = F.when(quad != "", F.when(number.isNotNull(), F.lower(F.concat(F.regexp_replace(text, r"[^:]*$", ""), as_groups)))).otherwise(text)
    halves = F.split(text, "::", -1)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = _GROUPS - F.size(left) - F.size(right)
    all_groups = F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), gap), right))
    good = (F.size(all_groups) == _GROUPS) & F.forall(all_groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    six = F.concat(F.lit("6"), F.array_join(F.transform(all_groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))
    return F.coalesce(four, F.when(good, six))


def _span(start: str | None, end: str | None) -> tuple | None:
    """First and last address of a range, or of the network that ``start`` names when there is no end."""
    try:
        if end is None:
            network = ipaddress.ip_network(start or "", strict=False)
            return network[0], network[-1]
        first, last = ipaddress.ip_address(start or ""), ipaddress.ip_address(end)
    except ValueError:
        return None
    return (first, last) if first.version == last.version and first <= last else None


def with_prefixes(ranges: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Each row once for each prefix of its range, with ``prefix``, and ``width`` and ``first`` to rank ranges: digits of equal
    length. ``end`` is left out for networks in CIDR form. Rows that name no range, or one that ends before it starts, go."""
    schema = T.StructType([*ranges.schema.fields, *[T.StructField(n, T.StringType()) for n in ("prefix", "width", "first")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(batch.schema.get_field_index(start)).to_pylist()
            ends = batch.column(batch.schema.get_field_index(end)).to_pylist() if end else [None] * len(starts)
            rows, made = [], ([], [], [])
            for k, pair in enumerate(zip(starts, ends)):
                span = _span(*pair) if pair[1] is not None or end is None else None
                if span is None:
                    continue
                bits = span[0].max_prefixlen
                for network in ipaddress.summarize_address_range(*span):
                    rows.append(k)
                    made[0].append(str(network.version) + format(int(network.network_address), f"0{bits}b")[:network.prefixlen])
                    made[1].append(str(int(span[1]) - int(span[0])).zfill(_DIGITS))
                    made[2].append(str(int(span[0])).zfill(_DIGITS))
            chosen = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, *[pa.array(m, pa.string()) for m in made]], [*batch.schema.names, "prefix", "width", "first"])

    return ranges.mapInArrow(work, schema)


def match(addresses: DataFrame, ip: str, prefixed: DataFrame, how: str = "inner") -> DataFrame:
    """Addresses with every range that holds them; ``left`` keeps those in none, once or more often. An address is repeated
    for the lengths that its family has among the prefixes, 33 or 129 at most."""
    lengths = sorted(prefixed.select(F.substring("prefix", 1, 1).alias("family"), F.length("prefix").alias("n")).distinct().collect())
    keys = F.array(*[F.when(F.col("__bits").startswith(r.family), F.substring("__bits", 1, r.n)) for r in lengths]).cast("array<string>")
    asked = addresses.withColumn("__bits", address_bits(F.col(ip))).withColumn("__key", F.explode_outer(F.array_compact(keys)))
    return asked.join(prefixed, F.col("__key") == F.col("prefix"), how).drop("__bits", "__key", "prefix")
