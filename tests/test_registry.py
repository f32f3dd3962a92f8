"""Retraining and the model a micro-batch takes."""

from datetime import datetime, timedelta

from helpers import events

from palisade.operators.registry import ModelRegistry, retrain
from palisade.plans.fixed_forest import fixed_model


def test_retraining_when_due(spark, scratch):
    registry, now = ModelRegistry(f"{scratch}/models"), datetime(2024, 11, 14)
    few, df = events(spark, [dict()] * 3), events(spark, [dict(bytes=i * 7, offset_us=i * 1_000_000) for i in range(60)])
    assert registry.current(spark) is None and registry.load(spark) is None
    assert retrain(registry, few, now) is None and registry.current(spark) is None
    assert retrain(registry, df, now, trees=3, sample=16) == "00000001"
    assert retrain(registry, df, now + timedelta(hours=23), trees=3, sample=16) is None
    assert retrain(registry, df, now + timedelta(hours=24), trees=4, sample=16) == "00000002"
    assert registry.load(spark).config["trees"] == 4 and registry.load(spark, "00000001").config["trees"] == 3
    assert retrain(registry, df, now + timedelta(days=60), trees=3, sample=16) is None  # nothing in the last thirty days


def test_a_batch_keeps_its_model(spark, scratch):
    """Batch 0 has no model, batch 1 the first; a replay of 1 after the second is out has the first again, batch 2 the second."""
    registry, notes, taken = ModelRegistry(f"{scratch}/models"), f"{scratch}/out/models", []
    taken.append(registry.for_batch(spark, notes, 0))
    for offset, epochs in ((-0.83, [1]), (-0.5, [1, 0, 2])):
        model = fixed_model(spark)
        model.offset = offset
        registry.publish(model, datetime(2024, 1, 1))
        taken += [registry.for_batch(spark, notes, epoch) for epoch in epochs]
    assert [m and m.offset for m in taken] == [None, -0.83, -0.83, None, -0.5]
