"""The predicate index against rules written out one by one."""

import random
import re

import pytest
from conftest import DATA
from helpers import events as made
from pyspark.sql import functions as F

from palisade.operators import ruleindex
from palisade.operators.rules import Condition, Rule, with_matched_rules
from palisade.plans.tables import sec_events
from palisade.session import land, number_rows

FIELDS = ["eventName", "sourceProvider", "severity", "actor.username", "actor.userType", "actor.ipAddress", "resource.resourceId", "resource.tags.criticality",
          "network.bytesSent", "network.source_port", "risk_score", "requestParameters.mfaUsed", "requestParameters.absent", "no.such.field", "threatIndicators", "outcome"]
VALUES = ["aws", "gcp", "user_3", "user_12", "Root", "203.0.113.7", "res-4", "high", "low", "GetObject", "ListBuckets", "success", "", True, False, None, 1, 0, 443, 1030,
          1e9, 0.97, 5_000_000, "443"]
PARTS = ["Bucket", "Get", "List", "user_", "_1", "res-", "203.0", "zz", "e", "", "Policy", "true", "0.9"]
PATTERNS = ["^(Get|List).*s$", "Delete(Bucket|Trail)", "^user_1\\d$", "(?i)getobject", "Put|Attach", "a+Bucket", "[A-Z]ucket", "(Create)?Access", "(Create){2}", "x*", "res-(4|7)$",
            "Describe[IV]\\w+", "(?:Get|Update)(Object|Function)", "User.?Policy", "\\QGet\\E"]


def drawn(rng, n):
    rules = []
    for i in range(n):
        conditions = []
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            operator = rng.choice(["equals", "equals", "not_equals", "contains", "not_contains", "in", "not_in", "regex", "greater_than", "less_than", "exists", "not_exists"])
            value = {"contains": PARTS, "not_contains": PARTS, "regex": PATTERNS}.get(operator, VALUES)
            one = rng.sample(VALUES, rng.randint(0, 3)) if operator in ("in", "not_in") else rng.choice(value)
            conditions.append(Condition(rng.choice(FIELDS), operator, one))
        rules.append(Rule(id=f"r{i}", name=f"n{i}", tags=("t",) * (i % 3), enabled=i % 11 != 5, conditions=tuple(conditions)))
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_index_is_the_plain_evaluation(spark, seed):
    events = sec_events(spark, DATA).limit(400)
    rules = drawn(random.Random(seed), 220)
    wanted = {r.eventId: r.matchedRules for r in with_matched_rules(events, rules, index_from=10**9).select("eventId", "matchedRules").collect()}
    indexed = ruleindex.with_matched_rules(events, rules)
    assert indexed.columns == [*events.columns, "matchedRules"]
    assert {r.eventId: r.matchedRules for r in indexed.select("eventId", "matchedRules").collect()} == wanted
    index = ruleindex.build(events.schema, [(i, r) for i, r in enumerate(rules, 1) if r.enabled])
    assert index.keys and index.words and index.rest


def test_repeated_rows_and_odd_packs(spark):
    events = sec_events(spark, DATA).limit(20)
    twice = events.unionByName(events)
    rule = Rule(id="a", name="a", conditions=(Condition("sourceProvider", "in", ["aws", "gcp", "aws"]),))
    got = ruleindex.with_matched_rules(twice, [rule])
    assert got.count() == 40 and got.where("size(matchedRules) = 1").count() == events.where("sourceProvider in ('aws', 'gcp')").count() * 2
    assert ruleindex.with_matched_rules(events, []).where("size(matchedRules) = 0").count() == 20
    assert ruleindex.with_matched_rules(events, [Rule(id="a", name="a")]).where("size(matchedRules) = 1").count() == 20
    assert ruleindex.with_matched_rules(events.limit(0), [rule]).count() == 0


def planned(df):
    """The plan before anything has run, while joins are chosen by estimates alone."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [True, False])
def test_no_event_rows_are_broadcast(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr("palisade.operators.joins.fits_broadcast", lambda _: False)
    rules = [Rule(id="a", name="a", conditions=(Condition("actor.username", "equals", "u3"),)),
             Rule(id="b", name="b", conditions=(Condition("eventName", "contains", "Bucket"),))]
    rows = land(number_rows(made(spark, [dict(username=f"u{i % 5}", eventName=["GetBucket", "Look"][i % 2]) for i in range(20)])))
    index = ruleindex.build(rows.schema, list(enumerate(rules, 1)))
    assert index.keys and index.words
    found = ruleindex._candidates(rows.select("rowId", F.array(*[ruleindex.views(rows.schema, p) for p in index.paths]).alias("fields")), index)
    hits = ruleindex.with_matched_rules(rows, rules).where(F.size("matchedRules") > 0).select("eventId", F.array_join("matchedRules.id", "|").alias("rules"))
    for df in (found, hits):
        assert "BuildLeft" not in planned(df) and ("SortMergeJoin" in planned(df)) != small
    assert {r.eventId: r.rules for r in hits.collect()} == {f"e{i:05d}": "|".join("a" * (i % 5 == 3) + "b" * (i % 2 == 0)) for i in range(20) if i % 5 == 3 or i % 2 == 0}


def test_a_rule_is_filed_where_fewest_are(spark):
    schema = sec_events(spark, DATA).schema
    rules = [(i, Rule(id=str(i), name="x", conditions=(Condition("sourceProvider", "equals", "aws"), Condition("actor.username", "equals", f"user_{i}")))) for i in range(1, 5001)]
    index = ruleindex.build(schema, rules)
    assert len(index.keys) == 5000 and not index.rest and max(map(len, index.keys.values())) == 1


@pytest.mark.parametrize("pattern,want", [
    ("abc", {"abc"}), ("^ab(cd|e+f)gh$", {"ab"}), ("a(bcd|efg)h", {"bcd", "efg"}), ("(abc)?d", {"d"}), ("x*", None), ("(?i)abc", None), ("[ab]cde", {"cde"}),
    ("(abc|d*)", None), ("(wxyz){2,}a", {"wxyz"}), ("\\QGet\\E", None), ("a\\.b", {"a.b"})])
def test_literals(pattern, want):
    got = ruleindex.literals(pattern)
    assert (set(got) if got else None) == want


def test_literals_are_in_every_match():
    rng = random.Random(5)
    for _ in range(400):
        pattern = "".join(rng.choice(["a", "b", "(ab|ba)", "(a|b)*", "b+", "[ab]", "(aab)", "(bb|)", ".", "^", "(?:ab){1,2}"]) for _ in range(rng.randint(1, 5)))
        found = ruleindex.literals(pattern)
        for _ in range(40):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 8)))
            if found and re.search(pattern, text):
                assert any(x in text for x in found), (pattern, text, found)
