import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from palisade.operators.rules import (
    Condition, Rule, RuleError, by_id, by_tag, enabled_rules, load_rules, parse_rule, resolve, rule_column, rules_frame,
    with_matched_rules,
)


def holds(df, field, operator, value):
    rule = Rule("r", "r", conditions=(Condition(field, operator, value),))
    return ids(df.where(rule_column(df.schema, rule)))


@pytest.fixture(scope="module")
def rows(spark):
    return events(spark, [
        dict(eventId="a", eventName="GetSecret", username="ann", risk=0.5, bytes=10),
        dict(eventId="b", eventName="", username=None, risk=0.0, bytes=None),
        dict(eventId="c", eventName="DeleteKey", username="", risk=None, bytes=20),
    ])


@pytest.mark.parametrize("field,operator,value,expected", [
    ("actor.username", "equals", "ann", ["a"]),
    ("actor.username", "equals", None, ["b"]),
    ("actor.username", "not_equals", "ann", ["b", "c"]),
    ("actor.username", "not_equals", None, ["a", "c"]),
    ("eventName", "contains", "e", ["a", "c"]),
    ("eventName", "contains", "", ["a", "c"]),  # an empty name counts as no value
    ("eventName", "not_contains", "Secret", ["b", "c"]),
    ("risk_score", "contains", "0", ["a"]),  # zero and null count as no value
    ("actor.username", "in", ["ann", "bob"], ["a"]),
    ("actor.username", "in", ["ann", None], ["a", "b"]),
    ("actor.username", "in", "ann", []),  # not a list
    ("actor.username", "not_in", ["ann"], ["b", "c"]),
    ("actor.username", "not_in", "ann", ["a", "b", "c"]),
    ("eventName", "regex", "^D.*y$", ["c"]),
    ("eventName", "regex", "", ["a", "c"]),
    ("network.bytesSent", "greater_than", 10, ["c"]),
    ("network.bytesSent", "less_than", 20, ["a"]),
    ("network.bytesSent", "greater_than", "10", []),  # cannot be ordered
    ("eventName", "greater_than", 1, []),
    ("network.bytesSent", "equals", "10", []),
    ("network.bytesSent", "equals", 10.0, ["a"]),
    ("risk_score", "exists", True, ["a", "b"]),
    ("risk_score", "not_exists", True, ["c"]),
    ("no.such.field", "exists", True, []),
    ("no.such.field", "equals", None, ["a", "b", "c"]),
    ("eventName.deeper", "not_in", ["x"], ["a", "b", "c"]),
])
def test_operators(rows, field, operator, value, expected):
    assert holds(rows, field, operator, value) == expected


def test_variant_paths(spark):
    df = events(spark, [dict(eventId="a"), dict(eventId="b"), dict(eventId="c"), dict(eventId="d")])
    text = F.when(F.col("eventId") == "a", '{"mfaUsed": false, "n": 3, "deep": {"x": "y"}}').when(
        F.col("eventId") == "b", '{"mfaUsed": "false", "n": "3"}').when(F.col("eventId") == "c", '{"mfaUsed": null}')
    df = df.withColumn("requestParameters", F.try_parse_json(text))
    assert holds(df, "requestParameters.mfaUsed", "equals", False) == ["a"]
    assert holds(df, "requestParameters.mfaUsed", "equals", "false") == ["b"]
    assert holds(df, "requestParameters.mfaUsed", "exists", True) == ["a", "b"]
    assert holds(df, "requestParameters.n", "greater_than", 2) == ["a"]
    assert holds(df, "requestParameters.deep.x", "regex", "y") == ["a"]


def test_map_and_struct_paths(spark):
    df = events(spark, [dict(eventId="a", resourceId="r", criticality="high"), dict(eventId="b")])
    assert holds(df, "resource.tags.criticality", "equals", "high") == ["a"]
    assert resolve(df.schema, "resource.tags.other").kind == "string"
    assert resolve(df.schema, "actor.nothing").kind == "missing"


def test_rule_sets(rows):
    always = Rule("always", "always")
    off = Rule("off", "off", enabled=False)
    both = Rule("both", "both", conditions=(Condition("eventName", "contains", "e"), Condition("risk_score", "exists", True)))
    out = {r["eventId"]: [m["id"] for m in r["matchedRules"]] for r in with_matched_rules(rows, [both, off, always]).collect()}
    assert out == {"a": ["both", "always"], "b": ["always"], "c": ["always"]}
    assert with_matched_rules(rows, [off]).first()["matchedRules"] == []


def test_more_rules_than_one_array(rows):
    many = [Rule(f"r{i}", f"r{i}") for i in range(150)]
    assert [m["ordinal"] for m in with_matched_rules(rows, many).first()["matchedRules"]] == list(range(1, 151))


def test_defaults_and_errors():
    rule = parse_rule({"name": "n", "conditions": [{"field": "f", "value": 1}]})
    assert (rule.id, rule.severity, rule.description, rule.tags, rule.enabled) == ("n", "medium", "", (), True)
    assert rule.conditions[0].operator == "equals"
    for bad in ({"id": "x"}, {"name": "x", "conditions": [{"field": "f"}]}, {"name": "x", "conditions": [{"value": 1}]},
                {"name": "x", "conditions": [{"field": "f", "value": 1, "operator": "almost"}]}):
        with pytest.raises(RuleError, match="x"):
            parse_rule(bad)


def test_loading(scratch, spark):
    with open(f"{scratch}/b.yaml", "w") as f:
        f.write("name: one\n---\n---\n- name: two\n  tags: [t]\n- name: three\n  enabled: false\n")
    with open(f"{scratch}/a.yml", "w") as f:
        f.write("name: four\n")
    rules = load_rules(scratch)
    assert [r.name for r in rules] == ["one", "two", "three", "four"]
    assert [r.name for r in by_tag(rules, "t")] == ["two"]
    assert by_id(rules, "four").name == "four" and by_id(rules, "none") is None
    assert [r.name for r in enabled_rules(rules)] == ["one", "two", "four"]
    table = rules_frame(spark, rules)
    assert ids(table.where(F.array_contains("tags", "t")), "id") == ["two"]
    assert len(load_rules()) == 10
