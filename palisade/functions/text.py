"""Null, emptiness and address helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_nonempty(*columns: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def user_key(actor: str = "actor") -> Column:
    return first_nonempty(F.col(f"{actor}.username"), F.col(f"{actor}.userId"))


def lookup_ip() -> Column:
    """The address enrichment works on: the actor's, else the network source."""
    return first_nonempty(F.col("actor.ipAddress"), F.col("network.sourceIp"))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long; null when it is not one."""
    octets = [F.get(F.split(ip, r"\."), F.lit(i)).try_cast("long") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    shape = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    in_range = F.greatest(*octets) <= 255
    return F.when(shape & in_range, value)


def utc_text(timestamp: Column) -> Column:
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def slot(us: Column, width: int) -> Column:
    """Index of the fixed-width time slot holding ``us`` (floor, also before 1970)."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")
