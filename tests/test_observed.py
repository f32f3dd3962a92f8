"""Counters of a running stream equal those of a batch over the same rows, and a replay counts nothing twice."""

import json
import time
from types import SimpleNamespace

import pytest
from conftest import DATA
from helpers import MINUTE, events
from pyspark.sql import functions as F

from palisade.operators.metrics import error_counts, progress_stats, stage_counts
from palisade.operators.normalize import is_valid, normalize
from palisade.session import land
from palisade.sources.adapters import raw_records
from palisade.streaming import observed
from palisade.streaming.jobs import ContinuousDetection, run_continuous
from palisade.streaming.observed import MetricsListener, observe_events, observe_raw, stream_counts, stream_latency


def counts(df):
    return {r.stage: r.n for r in df.collect()}


def settled(read, wanted, seconds=60):
    """Progress reports reach a listener a moment after their batch."""
    end = time.time() + seconds
    while time.time() < end:
        try:
            if read() == wanted:
                break
        except Exception:  # noqa: BLE001 - not written yet
            pass
        time.sleep(0.5)
    return read()


@pytest.fixture
def listener(spark, scratch):
    one = MetricsListener(spark, f"{scratch}/metrics")
    spark.streams.addListener(one)
    yield one
    spark.streams.removeListener(one)


def test_stream_counts_equal_batch_counts(spark, scratch, listener):
    odd = spark.createDataFrame([("nobody", "f", "{}"), ("aws_cloudtrail", "f", "not json"), (None, None, None)], "source string, source_file string, body string")
    raw = land(raw_records(spark, DATA).select("source", "source_file", "body").limit(900).unionByName(odd))
    raw.repartition(3).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    typed = observe_events(normalize(observe_raw(stream))).where(is_valid())
    handler = ContinuousDetection(f"{scratch}/out", limit=5, counting=True)
    query = run_continuous(typed, handler, f"{scratch}/checkpoint", available_now=True)
    query.awaitTermination()
    assert query.exception() is None

    done = spark.read.parquet(f"{scratch}/out/alerts")
    want = counts(stage_counts(raw, normalize(raw), done))
    errors = {f"errors_{r.component}": r.n for r in error_counts(raw, normalize(raw)).collect()}
    late = spark.read.schema("eventId string").parquet(f"{scratch}/out/late").count()
    want |= errors | {"events_late": late, "events_judged": want["events_processed"] - late}

    def read():
        return counts(stream_counts(spark, f"{scratch}/metrics/counts", f"{scratch}/out/counts"))

    assert settled(read, want) == want
    assert want["alerts_generated"] > 0 and errors["errors_normalization"] > 0

    figures = stream_latency(spark, f"{scratch}/metrics").first().asDict()
    reports = [{"numInputRows": p["numInputRows"], "durationMs": p["durationMs"]} for p in query.recentProgress]
    assert figures == pytest.approx(progress_stats(reports))


def test_a_batch_with_counts_has_its_time(spark, scratch, monkeypatch):
    seen = []
    monkeypatch.setattr(observed, "write_counts", lambda spark, rows, folder: seen.append(stream_latency(spark, f"{scratch}/metrics").first().events))
    report = {"id": "q", "batchId": 0, "numInputRows": 7, "durationMs": {"triggerExecution": 5}, "observedMetrics": {"raw": {"events_ingested": 7}}}
    MetricsListener(spark, f"{scratch}/metrics").onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json=json.dumps(report))))
    assert seen == [7]


def test_a_replay_is_counted_once(spark, scratch):
    first = events(spark, [dict(eventId="a", eventName="SecretOne"), dict(eventId="b", eventName="SecretTwo", offset_us=30 * MINUTE)])
    second = events(spark, [dict(eventId="c", eventName="SecretThree", offset_us=MINUTE), dict(eventId="d", eventName="SecretTwo", offset_us=31 * MINUTE)])
    handler = ContinuousDetection(f"{scratch}/out", counting=True)
    for epoch, batch in ((0, first), (0, first), (1, second), (1, second)):
        handler(batch, epoch)
    got = counts(stream_counts(spark, f"{scratch}/out/counts"))
    assert (got["events_judged"], got["events_late"], got["alerts_generated"]) == (3, 1, 3)
    done = spark.read.parquet(f"{scratch}/out/alerts").groupBy("outcome").count().collect()
    assert {f"alerts_{r.outcome}": r["count"] for r in done} == {s: n for s, n in got.items() if n and s.startswith("alerts_") and s != "alerts_generated"}


def test_an_empty_batch_and_no_counts(spark, scratch):
    nothing = events(spark, [dict(eventId="a")]).where(F.lit(False))
    ContinuousDetection(f"{scratch}/out", counting=True)(nothing, 0)
    assert set(counts(stream_counts(spark, f"{scratch}/out/counts")).values()) == {0}
    spark.createDataFrame([], "events long, took_ms long").write.parquet(f"{scratch}/metrics/times")
    assert tuple(stream_latency(spark, f"{scratch}/metrics").first()) == (0, 0.0, 0.0, 0.0, 0.0)
