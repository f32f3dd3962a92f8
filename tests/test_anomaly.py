"""Isolation forest: planted outliers, refusal, persistence."""

import math
import random

import numpy as np
from conftest import DATA
from helpers import events
from pyspark.sql import functions as F

from palisade.operators import anomaly as an
from palisade.operators.alerts import build_alerts
from palisade.operators.anomaly import isolation_score, train
from palisade.operators.rules import load_rules
from palisade.plans.detection import detect
from palisade.plans.fixed_forest import fixed_model
from palisade.plans.tables import sec_events


def population(spark, n=600):
    rng = random.Random(1)
    rows = [dict(username="u", bytes=rng.randrange(1000), offset_us=rng.randrange(3600) * 1_000_000) for _ in range(n)]
    rows += [dict(eventId=f"odd{i}", bytes=10**9 * (i + 1), severity="critical", outcome="failure", risk=0.9,
                  eventType="network_traffic") for i in range(4)]
    return events(spark, rows)


def test_outliers_rank_first(spark):
    df = population(spark)
    model = an.train(df)
    scored = df.select("eventId", an.isolation_score(model).alias("s")).orderBy("s").limit(4).collect()
    assert {r["eventId"] for r in scored} == {"odd0", "odd1", "odd2", "odd3"}
    flagged = an.with_anomaly(df, model).where("anomaly.isAnomaly")
    assert 1 <= flagged.count() <= 0.02 * df.count() + 1
    assert all(0.5 < r["anomaly"]["score"] <= 1 / (1 + math.exp(-1)) for r in flagged.collect())


def test_training_is_repeatable_and_bounded(spark):
    df = population(spark)
    first, second = an.train(df), an.train(df.repartition(7))
    key = ["tree", "node"]
    assert first.nodes.orderBy(*key).collect() == second.nodes.orderBy(*key).collect()
    assert first.nodes.select("tree").distinct().count() == an.TREES
    assert first.nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * an.SAMPLE - 1


def test_too_few_events(spark):
    assert an.train(events(spark, [dict()] * 9)) is None
    assert an.train(events(spark, [dict(offset_us=i) for i in range(10)])) is not None


def test_save_and_load(spark, scratch):
    df = population(spark, 60)
    model = an.train(df, trees=10)
    an.save_model(model, scratch, "v1")
    again = an.load_model(spark, scratch, "v1")
    assert again.config == model.config and again.offset == model.offset
    both = df.select(an.isolation_score(model).alias("a"), an.isolation_score(again).alias("b"))
    assert both.where("a <> b").count() == 0


def test_path_lengths():
    assert an.average_path(1) == 0.0 and an.average_path(2) == 1.0
    assert abs(an.average_path(256) - 10.244) < 0.001
    rows = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 3.0]])
    tree = an.grow_tree(rows, np.random.default_rng(0), 8)
    assert all(node[1] in (-1, 1) for node in tree)  # a constant feature is never chosen
    assert sum(1 for node in tree if node[1] == -1) == 3


def test_scaling_of_a_constant_feature(spark):
    table = an.features(events(spark, [dict(bytes=1), dict(bytes=3)]))
    row = an.scale(table, an.fit_scaler(table)).orderBy("eventId").first()
    assert row["bytes_sent"] == -1.0 and row["is_data_access"] == 0.0


def test_retraining(spark):
    df = events(spark, [dict(offset_us=i * 86_400_000_000) for i in range(40)])
    as_of = F.lit("2024-12-20 12:00:00").cast("timestamp")
    assert an.training_window(df, as_of).count() == 30
    due = spark.range(1).select(
        an.retrain_due(F.lit(None).cast("timestamp"), as_of).alias("a"),
        an.retrain_due(as_of - F.expr("interval 23 hours"), as_of).alias("b"),
        an.retrain_due(as_of - F.expr("interval 24 hours"), as_of).alias("c")).first()
    assert tuple(due) == (True, False, True)


def test_both_walks_agree(spark):
    """The expression and the walk over batches, for a trained forest and for the fixed one."""
    rows = sec_events(spark, DATA)
    for model in (train(rows, trees=7, sample=64), fixed_model(spark)):
        got = rows.select(isolation_score(model, native=True).alias("a"), isolation_score(model, native=False).alias("b")).collect()
        assert got and all(abs(r.a - r.b) < 1e-12 for r in got)


def test_the_third_engine_decides_alone(spark):
    """Some events are threats by the forest only; the alert says so."""
    fused = detect(sec_events(spark, DATA.replace("sf0.001", "sf0.01")), load_rules(), fixed_model(spark))
    alone = build_alerts(fused.where("array_join(detectionMethods, ',') = 'anomaly'"))
    row = alone.first()
    assert row is not None and row.title.startswith("Anomalous Activity Detected: ") and "**Anomaly Detection:**" in row.description
    assert row.indicators == ["Anomalous feature combination"]
