"""Card numbers beside other digits: expiry, CVV, another card."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import pii

SAID = {
    "card 4539 1488 0343 6467 12/27": ["4539 1488 0343 6467"],
    "card 4539.1488.0343.6467.12/27": ["4539.1488.0343.6467"],
    "card 4539 1488 0343 6467 12/27 123": ["4539 1488 0343 6467"],
    "card 4539 1488 0343 6467 123": ["4539 1488 0343 6467"],
    "card 4539.1488.0343.6467 4556.7375.8689.9855": ["4539.1488.0343.6467", "4556.7375.8689.9855"],
}


def numbered(rng):
    """A card number with a right check digit, in groups of four."""
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    text = "".join(map(str, [*digits, -total % 10]))
    return " ".join(text[i:i + 4] for i in range(0, 16, 4))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, f"note {i} of the day, card {numbered(rng)} was used; call +1 (20{i % 10}) 555-0{100 + i} or joe{i}@mail{i % 7}.example.org, "
                f"order {rng.randrange(10**7)} {rng.randrange(10**7)} on 2024-01-{1 + i % 28:02d}") for i in range(400)]
    return pii.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_all_readings_are_proposed(spark):
    rows = spark.createDataFrame([(t,) for t in SAID], "text string").select("text", pii.wide_spans(F.col("text"), "card").alias("found"))
    for r in rows.collect():
        got = {r.text[s.start:s.end] for s in r.found}
        assert all(s.match == r.text[s.start:s.end] for s in r.found) and got >= set(SAID[r.text])


def test_readings_end_at_gaps_and_odd_input(spark):
    said = [None, "", "4539 1488 0343   6467", "1 " * 3000, "日本 4539 1488 0343 6467 12", "4539148803436467 12/27"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "n int, text string").select("n", "text", pii.card_readings(F.col("text")).alias("found"))
    got = {r.n: [s.match for s in r.found or []] for r in rows.collect()}
    assert got[0] == got[1] == got[2] == got[3] == [] and "4539 1488 0343 6467" in got[4] and "4539148803436467" in got[5]


def test_cards_beside_other_digits_are_found(spark, model):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SAID)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(rows, model).collect()}
    for i, (said, cards) in enumerate(SAID.items()):
        assert not any(c in clean[i] for c in cards) and clean[i].count("[CARD]") == len(cards), (said, clean[i])
