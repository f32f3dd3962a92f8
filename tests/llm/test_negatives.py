"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from palisade.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, planes string, anchor_block int, score long"


def plain(rows):
    """By id; of rows with one id the smallest label, then vector."""
    ready = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = math.fmod(label + 1, 10) if i % 7 == 0 else label
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if any(abs(x) >= math.sqrt(2**62 / max(1, len(v))) for x in ints):
            continue
        ready[i] = min(ready.get(i, (label, ints)), (label, ints))
    out = set()
    for a, (label, v) in ready.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in ready.items() if i != a and len(w) == len(v))
        for s, p, other in [x for x in scores if x[2] == label][:5]:
            fit = [(n, t) for t, n, o in scores if o != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out |= {(a, p, k, n, -s, -t) for k, (n, t) in enumerate(fit, 1)}
    return out


def mined(spark, rows):
    found = negatives.report(spark.createDataFrame([(*r, "p", 3, 4) for r in rows], SCHEMA)).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    return got


def drawn(seed, count, width, spread=1.0, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(0.1, spread) for _ in range(width)]) for i in range(count)]


@pytest.mark.parametrize("rows,blocks", [(400, 200), (90, 30), (41, 7)])
@pytest.mark.parametrize("width", [8, 13, 64])
def test_against_all_pairs(spark, monkeypatch, rows, blocks, width):
    for name in ("ROWS", "ANCHORS", "CHUNK"):
        monkeypatch.setattr(negatives, name, {"ROWS": rows, "ANCHORS": 3, "CHUNK": blocks}[name])
    data = drawn(width, 400, width)
    got = mined(spark, data)
    assert got == plain(data) and got


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 60)
    monkeypatch.setattr(negatives, "CHUNK", 16)
    rng = random.Random(3)
    data = [(i, rng.randrange(2), [float(rng.randrange(3)) for _ in range(3)]) for i in range(300)]  # few different scores
    data += [(1000 + i, 1, [2.0, 2.0, 1.0]) for i in range(250)] + data[:40]
    assert mined(spark, data) == plain(data)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [*drawn(5, 60, 4), (None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, [None, 1.0, 1.0, 1.0]), (103, 1, [nan] * 4), (104, 1, [inf] * 4),
            (150, 1, []), (151, 1, []), (152, 2, []), (200, 1, [1.0, 2.0]), (201, 1, [2.0, 2.0]), (202, 0, [1.5, 1.0]), (250, 1, [0.0] * 4), (251, 1, [-1.0] * 4),
            (-50, 2, [0.5] * 4), (-49, -3, [0.4] * 4), (300, 0, [3e37] * 4), (350, 0, [2e6, 1.0, -2e6, 1.0]), (351, 0, [3e6, 1.0, -2e6, 1.0]), (352, 1, [2e6, 1.0, -1e6, 1.0]),
            (0, 1, [9.0] * 4), (0, 0, [9.0] * 4), (0, 0, [9.0] * 4), (400, 1, [0.3] * 9000), (401, 1, [0.3] * 9000), (402, 2, [0.2] * 9000)]
    got = mined(spark, data)
    assert got == plain(data) and {a for a, *_ in got} >= {350, 400}
    assert mined(spark, []) == set() and mined(spark, [(50, 1, [1.0])]) == set()


def test_scores_from_planes():
    rng = np.random.default_rng(1)
    for width, scale in ((1, 3), (8, 200), (20, 10**6), (64, 2**27)):
        a, b = rng.integers(-scale, scale + 1, (7, width)), rng.integers(-scale, scale + 1, (9, width))
        packed = negatives.pack(b)
        assert (negatives.unpack(packed, width) == b).all()
        assert (negatives.scores(negatives.subset_sums(a), packed) == b @ a.T).all()
    for share in (50, 95):
        for s in (0, 1, 99, 100, 2**62 - 1):
            assert negatives.percent(np.array([s]), share)[0] == s * share // 100 and negatives.percent(np.array([s]), share, up=True)[0] == -(-s * share // 100)
