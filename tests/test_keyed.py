"""Frequency checks on Spark's keyed state give what the batch operators give."""

import random
import time

import numpy as np
from helpers import events
from pyspark.sql import functions as F

from palisade.operators import heuristics as he
from palisade.streaming import keyed

SECOND = 1_000_000


def stormy(rng, minutes):
    """Users and addresses that are busy now and then, among them one that always is; failed logins in bursts."""
    rows, t = [], 0
    while t < minutes * 60:
        t += rng.random() * 4
        who = rng.choice(["hot", "hot", "hot", "a", "b", "c"])
        burst = int(t // 400) % 2 == 0
        rows.append(dict(offset_us=int(t * SECOND), username=who if burst or who == "hot" else f"u{rng.randrange(9)}", ip=rng.choice(["10.0.0.1", "10.0.0.1", "10.0.0.2", ""]),
                         eventName=rng.choice(["Look", "Look", "Take"]), outcome="failure" if burst and rng.random() < 0.3 else "success",
                         eventType="authentication" if rng.random() < 0.4 else "resource_access"))
    return rows


def expected(df):
    found = set()
    for check, operator in (("user_count", he.user_frequency), ("ip_count", he.ip_frequency), ("failed_count", he.failed_logins)):
        found |= {(check, r.eventId, r.mark, r[check]) for r in operator(df).collect()}
    return found


def test_prior():
    times = np.array([0, 5, 5, 9, 15])
    assert keyed.prior(times, np.array([5, 9, 10, 15]), 10).tolist() == [1, 3, 3, 1]


def test_stream_with_restart_equals_batch(spark, scratch):
    """Files in order, but shuffled inside and with stragglers from the file before; stopped and started again half way."""
    rng = random.Random(3)
    rows = stormy(rng, 70)
    # the last two events are a way off, so that all before them is over
    df = events(spark, rows + [dict(eventId="last9", offset_us=10 * 3600 * SECOND), dict(eventId="last10", offset_us=11 * 3600 * SECOND)])
    wanted = expected(df)
    assert {c for c, *_ in wanted} == set(keyed.CHECKS)
    minute = F.floor((F.unix_micros("timestamp") - F.lit(df.agg(F.min(F.unix_micros("timestamp"))).first()[0])) / (60 * SECOND))
    late = F.when(F.pmod(F.xxhash64("eventId"), F.lit(9)) == 0, 1).otherwise(0)
    parts = df.withColumn("part", F.when(F.col("eventId").startswith("last"), F.substring("eventId", 5, 2).cast("int")).otherwise(F.least(F.floor((minute + 6 * late) / 10), F.lit(8)))).persist()
    names = df.columns
    sizes = []

    def write(part):
        parts.where(F.col("part") == part).select(*names).orderBy(F.xxhash64("eventId")).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        time.sleep(1.1)

    def drain():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
        query = keyed.run_frequency(stream, f"{scratch}/out", f"{scratch}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
        sizes.extend(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    for part in range(4):
        write(part)
    drain()
    for part in range(4, 11):
        write(part)
    drain()
    got = [(r.check, r.eventId, r.mark, r.prior) for r in spark.read.parquet(f"{scratch}/out").collect()]
    assert len(got) == len(set(got))
    assert set(got) == wanted, (len(got), len(wanted), sorted(wanted - set(got), key=str)[:5], sorted(set(got) - wanted, key=str)[:5])
    busiest = max(sizes)
    assert max(sizes[len(sizes) // 2:-1]) <= busiest and sizes[-1] < busiest / 5  # what is over is gone
