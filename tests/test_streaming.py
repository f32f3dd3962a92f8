"""The continuous job gives what one batch run gives."""

import os
import time

from conftest import DATA
from helpers import MINUTE, START, events, ids
from pyspark.sql import functions as F

from palisade.operators.alerts import build_alerts
from palisade.operators.dedup import deduplicate
from palisade.operators.normalize import known_source
from palisade.operators.metrics import engine_statistics, progress_stats, sliding_counts
from palisade.operators.rules import load_rules, rules_frame
from palisade.operators.throttle import outcomes
from palisade.plans.detection import detect, dispatch, events_from_raw, run, run_raw, run_store
from palisade.session import land
from palisade.sources.adapters import raw_records, sec_events
from palisade.sources.feeds import stream_json_lines
from palisade.sources.store import merge_events
from palisade.streaming.jobs import ContinuousDetection, keep_running, run_continuous, stream_sliding_counts
from palisade.streaming.state import StateTables

LIMIT, DEDUP_US, THROTTLE_US = 8, MINUTE, 5 * MINUTE


def feed(spark, df, folder, cuts):
    """Write ``df`` as one file per time part, in order, and open it as a stream of one file a batch."""
    us = F.unix_micros("timestamp")
    low, high = df.agg(F.min(us), F.max(us)).first()
    step = (high - low) // cuts + 1
    for i in range(cuts):
        df.where((us >= low + i * step) & (us < low + (i + 1) * step)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, handler, folder):
    query = run_continuous(stream, handler, f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    assert query.exception() is None


def ends(df):
    return {r["alertId"]: (r["outcome"], r["title"], r["fingerprint"], r["anchor"], tuple(r["indicators"])) for r in df.collect()}


def test_stream_equals_batch(spark, scratch):
    df = land(sec_events(spark, DATA, burst=True))
    # A thousand events compressed once more, so that every history check has something to say.
    start = 1704067200000000
    squeezed = F.timestamp_micros(F.lit(start) + F.floor((F.unix_micros("timestamp") - start) / 10).cast("long"))
    df = land(df.withColumn("timestamp", squeezed).withColumn(
        "eventName", F.when(F.pmod(F.xxhash64("eventId"), F.lit(4)) == 0, F.concat(F.lit("Act"), F.pmod(
            F.xxhash64("eventId"), F.lit(40)).cast("string"))).otherwise(F.col("eventName"))))
    stream = feed(spark, df, scratch, 3)
    drain(stream, ContinuousDetection(f"{scratch}/out", limit=LIMIT, dedup_us=DEDUP_US, throttle_us=THROTTLE_US), scratch)
    streamed = ends(spark.read.parquet(f"{scratch}/out/alerts"))
    alerts = land(build_alerts(detect(df, load_rules())))
    batch = ends(outcomes(land(deduplicate(alerts, DEDUP_US)), LIMIT, THROTTLE_US))
    assert streamed == batch
    said = {i.split(" ")[0] + " " + i.split(" ")[1] for row in batch.values() for i in row[4]}
    assert {"High frequency", "Multiple failed", "Unusual action", "Unusual user", "Login from"} <= said
    assert {row[0] for row in batch.values()} == {"dispatched", "deduplicated", "throttled"}


def test_late_events_go_aside(spark, scratch):
    first = events(spark, [dict(eventId="a", eventName="SecretOne"), dict(eventId="b", eventName="SecretTwo", offset_us=30 * MINUTE)])
    second = events(spark, [dict(eventId="c", eventName="SecretThree", offset_us=20 * MINUTE),
                            dict(eventId="d", eventName="SecretFour", offset_us=20 * MINUTE + 1)])
    handler = ContinuousDetection(f"{scratch}/out")
    handler(first, 0)
    handler(second, 1)
    assert ids(spark.read.parquet(f"{scratch}/out/late")) == ["c"]
    assert ids(spark.read.parquet(f"{scratch}/out/alerts")) == ["a", "b", "d"]


def test_a_replayed_batch_changes_nothing(spark, scratch):
    df = events(spark, [dict(eventId="a", eventName="SecretOne"), dict(eventId="b", eventName="SecretOne", offset_us=1)])
    handler = ContinuousDetection(f"{scratch}/out")
    handler(df, 0)
    before = sorted(map(str, spark.read.parquet(f"{scratch}/out/alerts").collect()))
    handler(df, 0)
    assert sorted(map(str, spark.read.parquet(f"{scratch}/out/alerts").collect())) == before


def test_rules_are_reread(spark, scratch):
    os.makedirs(f"{scratch}/rules")
    df = events(spark, [dict(eventId="a", eventName="Plain")])
    handler = ContinuousDetection(f"{scratch}/out", rules=f"{scratch}/rules")
    handler(df, 0)
    assert spark.read.parquet(f"{scratch}/out/alerts").count() == 0
    with open(f"{scratch}/rules/r.yaml", "w") as f:
        f.write("name: everything\n")
    handler(df.withColumn("eventId", F.lit("b")), 1)
    assert ids(spark.read.parquet(f"{scratch}/out/alerts")) == ["b"]


def test_dry_run_writes_no_alerts(spark, scratch):
    ContinuousDetection(f"{scratch}/out", dry_run=True)(events(spark, [dict(eventName="Secret")]), 0)
    assert not os.path.exists(f"{scratch}/out/alerts") and os.path.exists(f"{scratch}/out/state")


def test_sliding_counts_stream(spark, scratch):
    df = land(sec_events(spark, DATA))
    stream = feed(spark, df, scratch, 2)
    stream_sliding_counts(stream, "sourceProvider", f"{scratch}/windows", f"{scratch}/checkpoint").awaitTermination()
    got = set(map(tuple, spark.read.parquet(f"{scratch}/windows").collect()))
    expected = set(map(tuple, sliding_counts(df, "sourceProvider").collect()))
    last = df.agg(F.max("timestamp")).first()[0]
    assert got <= expected and all((last - row[0]).total_seconds() <= 15 * 60 for row in expected - got)


def test_state_tables(spark, scratch):
    state = StateTables(spark, scratch)
    assert state.latest("x", 0) is None and state.grown("y", 0) is None
    for epoch in range(3):
        state.replace("x", epoch, spark.range(epoch + 1))
        state.add("y", epoch, spark.range(epoch, epoch + 1))
    assert state.latest("x", 2).count() == 2 and ids(state.grown("y", 2), "id") == [0, 1]


def test_a_failed_job_restarts(spark, scratch):
    events(spark, [dict(eventId="a")]).select("eventId").write.parquet(f"{scratch}/in")
    seen, calls = [], []

    def handle(batch, epoch):
        calls.append(epoch)
        if len(calls) == 1:
            raise RuntimeError("first try fails")
        seen.extend(r["eventId"] for r in batch.collect())

    def start():
        stream = spark.readStream.schema("eventId string").parquet(f"{scratch}/in")
        return run_continuous(stream, handle, f"{scratch}/checkpoint", available_now=True)

    assert keep_running(start, pause_seconds=0.1) == 1 and seen == ["a"] and calls == [0, 0]
    query = start()
    query.awaitTermination()
    assert progress_stats(query.recentProgress)["events"] == 0


def test_progress_figures():
    reports = [{"numInputRows": 10, "durationMs": {"triggerExecution": 100}}, {"numInputRows": 30, "durationMs": {"triggerExecution": 100}},
               {"numInputRows": 0, "durationMs": {"triggerExecution": 5}}]
    stats = progress_stats(reports)
    assert (stats["events"], stats["avg_ms"], stats["max_ms"], stats["events_per_second"]) == (40, 5.0, 10.0, 200.0)


def test_engine_statistics(spark):
    row = engine_statistics(rules_frame(spark, load_rules()), True, False).first()
    assert tuple(row) == (10, 10, True, False)


def test_json_lines_stream(spark, scratch):
    os.makedirs(f"{scratch}/lines")
    with open(f"{scratch}/lines/a.json", "w") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    query = stream_json_lines(spark, f"{scratch}/lines", "aws_cloudtrail").writeStream.format("memory").queryName("lines").trigger(
        availableNow=True).start()
    query.awaitTermination()
    assert spark.table("lines").where("source = 'aws_cloudtrail'").count() == 2


def test_full_run_from_raw(spark, scratch):
    done = run_raw(raw_records(spark, DATA), load_rules(), f"{scratch}/store")
    counts = {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
    assert counts.get("dispatched", 0) > 0
    stored = spark.read.parquet(f"{scratch}/store")
    assert run(stored.drop("date"), load_rules(), limit=2).where("outcome = 'throttled'").count() > 0


def test_events_without_a_fit_time_are_set_aside(spark, scratch):
    """Null times and far futures in the first and in a later batch: set aside, and detection goes on."""
    handler = ContinuousDetection(f"{scratch}/out", clock=lambda: START.timestamp() + 3600 * 24)
    for epoch, offset in enumerate((0, MINUTE)):
        batch = events(spark, [dict(eventId=f"n{epoch}"), dict(eventId=f"f{epoch}", offset_us=10 * 365 * 1440 * MINUTE),
                               dict(eventId=f"k{epoch}", eventName="DeleteSecret", offset_us=offset)])
        batch = batch.withColumn("timestamp", F.when(~F.col("eventId").startswith("n"), F.col("timestamp")))
        handler(batch, epoch)
        aside = ids(spark.read.schema(batch.schema).parquet(f"{scratch}/out/late/epoch={epoch}"))
        assert aside == [f"f{epoch}", f"n{epoch}"]
        assert {r.eventId for r in spark.read.parquet(f"{scratch}/out/state/recent/epoch={epoch}").collect()} >= {f"k{epoch}"}


def test_second_run_keeps_the_first_days_store(spark, scratch):
    raw = land(raw_records(spark, DATA))
    typed = events_from_raw(raw)
    days = [r.d for r in typed.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").limit(2).collect()]
    store = f"{scratch}/store"
    first, second = (land(typed.where(F.to_date("timestamp") == d)) for d in days)
    merge_events(first, store)
    merge_events(second, store)
    merge_events(first.limit(3), store)
    assert sorted(ids(spark.read.parquet(store))) == sorted(ids(first) + ids(second))


def test_flows_of_one_millisecond_stay_in_the_store(spark, scratch):
    def flows(*ports):
        bodies = [f'{{"timestamp": 1710000000000, "src_addr": "10.0.0.1", "dst_addr": "10.0.0.2", "src_port": "{p}", "dst_port": "443",'
                  f' "protocol": "6", "packets": "3", "bytes": "120", "action": "ACCEPT"}}' for p in ports]
        return events_from_raw(spark.createDataFrame([("aws_vpc_flow_logs", "f", b) for b in bodies], "source string, source_file string, body string"))

    store = f"{scratch}/store"
    assert flows(1, 2).select("eventId").distinct().count() == 1
    merge_events(flows(1, 2), store)
    merge_events(flows(2, 3), store)  # 2 is delivered again
    merge_events(flows(4), store)
    assert sorted(r.port for r in spark.read.parquet(store).select(F.col("network.source_port").alias("port")).collect()) == [1, 2, 3, 4]


def test_raw_run_keeps_unknown_and_rejected_records(spark, scratch):
    raw = land(raw_records(spark, DATA))
    odd = raw.limit(5).withColumn("source", F.lit("somewhere_else"))
    run_raw(raw.unionByName(odd), load_rules(), f"{scratch}/store")
    kept = spark.read.parquet(f"{scratch}/store").count()
    rejected = spark.read.parquet(f"{scratch}/store-rejected").count()
    assert spark.read.parquet(f"{scratch}/store-unknown").count() == raw.where(~known_source()).count() + 5
    assert kept + rejected == raw.where(known_source()).count()


def test_bounded_run_and_dispatch(spark, scratch):
    df = land(sec_events(spark, DATA, burst=True))
    whole = land(run(df, load_rules(), limit=LIMIT))
    stamps = [r.t for r in df.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("t").collect()]
    start, end = stamps[len(stamps) // 3], stamps[2 * len(stamps) // 3]
    part = land(run(df, load_rules(), start=start, end=end, limit=LIMIT))
    wanted = whole.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    assert ids(part, "alertId") == ids(wanted, "alertId") and part.count() < whole.count()
    loose = run(df, load_rules(), deduplicating=False, throttling=False)
    assert loose.where("outcome = 'dispatched'").count() == loose.count() == whole.count()
    assert run(df, [], heuristics=False).count() == 0
    assert dispatch(whole, {"webhook": {}}, f"{scratch}/out") == {}
    sent = spark.read.parquet(f"{scratch}/out/channel=webhook")
    assert ids(sent, "alertId") == ids(whole.where("outcome = 'dispatched'"), "alertId")


def test_store_run_reads_a_range(spark, scratch):
    df = land(sec_events(spark, DATA))
    merge_events(df, f"{scratch}/store")
    low, high = df.agg(F.min("timestamp"), F.max("timestamp")).first()
    start, end = (low + (high - low) / 2).strftime("%Y-%m-%d %H:%M:%S"), high.strftime("%Y-%m-%d %H:%M:%S")
    got = run_store(spark, f"{scratch}/store", load_rules(), start, end, throttling=False)
    assert ids(got, "alertId") == ids(run(df, load_rules(), start=start, end=end, throttling=False), "alertId")


def test_grown_state_is_merged(spark, scratch, monkeypatch):
    monkeypatch.setattr(StateTables, "MERGE", 3)
    state = StateTables(spark, scratch)
    for epoch in range(11):
        for _ in range(2):  # each micro-batch once more, as after a restart
            grown = state.grown("seen", epoch)
            assert ids(grown, "id") == list(range(epoch)) if epoch else grown is None
            state.add("seen", epoch, spark.range(epoch, epoch + 1).coalesce(1))
    kept = sorted(int(p.split("=")[1]) for p in os.listdir(f"{scratch}/seen"))
    assert kept == list(range(6, 11)) and len(os.listdir(f"{scratch}/seen-merged")) <= 2
