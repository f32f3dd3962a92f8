"""Queries over rule operators, the default rules and their catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators.alerts import alert_severity
from palisade.operators.fusion import overall_score, rule_score
from palisade.operators.rules import (
    Condition, Rule, by_tag, load_rules, rule_column, rules_frame, with_matched_rules,
)
from palisade.plans.oracle import RULES, matched, picked, rule_values, sec
from palisade.plans.registry import query
from palisade.plans.tables import sec_events

# Each operator on its own: (query, condition(s), the same predicate in SQL).
OPERATOR_CASES = [
    ("q_rule_equals", [("sourceProvider", "equals", "aws")], "provider = 'aws'"),
    ("q_rule_not_equals", [("actor.userType", "not_equals", "Root")], "usertype <> 'Root'"),
    ("q_rule_contains", [("eventName", "contains", "Bucket")], "contains(name, 'Bucket')"),
    ("q_rule_not_contains", [("eventName", "not_contains", "Bucket")], "NOT contains(name, 'Bucket')"),
    ("q_rule_in", [("severity", "in", ["high", "critical"])], "severity IN ('high','critical')"),
    ("q_rule_not_in", [("actor.geo_location.city", "not_in", ["Paris"]), ("actor.geo_location.country", "not_in", ["US", "CA"])],
     "country NOT IN ('US','CA')"),
    ("q_rule_regex", [("eventName", "regex", "^(Get|List).*s$")], "regexp_matches(name, '^(Get|List).*s$')"),
    ("q_rule_gt", [("risk_score", "greater_than", 0.96)], "coalesce(risk > 0.96, false)"),
    ("q_rule_lt", [("network.bytesSent", "less_than", 1000000000)], "bytes < 1000000000"),
    ("q_rule_exists", [("risk_score", "exists", True), ("actor.geo_location.city", "not_exists", True)], "risk IS NOT NULL"),
    ("q_rule_variant", [("requestParameters.mfaUsed", "equals", True), ("requestParameters.absent", "equals", None)], "mfa"),
]


def _single(conditions):
    rule = Rule(id="r", name="r", conditions=tuple(Condition(*c) for c in conditions))

    def run(spark, folder):
        events = sec_events(spark, folder)
        return events.where(rule_column(events.schema, rule)).select("eventId")
    return run


for _name, _conditions, _predicate in OPERATOR_CASES:
    query(_name, f"WITH {sec()} SELECT eventId FROM sec WHERE {_predicate}")(_single(_conditions))


def _packed(ordinal):
    def run(spark, folder):
        events = sec_events(spark, folder)
        return events.where(rule_column(events.schema, load_rules()[ordinal - 1])).select("eventId")
    return run


for _ordinal, _predicate in RULES.items():
    query(f"q_pack_{_ordinal}", f"WITH {sec()} SELECT eventId FROM sec WHERE {_predicate}")(_packed(_ordinal))


@query("q_rule_matches", f"""
WITH {sec()}, {matched()}
SELECT eventId, array_to_string(list_transform(hits, lambda h: {picked('id')}[h]), '|') AS rules FROM ruled""")
def rule_matches(spark, folder):
    events = with_matched_rules(sec_events(spark, folder), load_rules())
    return events.select("eventId", F.array_join(F.transform("matchedRules", lambda r: r["id"]), "|").alias("rules"))


@query("q_severity_counts", f"""
WITH {sec()}, {matched()}, s AS (
  SELECT list_transform(hits, lambda h: {picked('severity')}[h]) AS sev FROM ruled WHERE len(hits) > 0)
SELECT CASE WHEN list_contains(sev, 'critical') THEN 'critical' WHEN list_contains(sev, 'high') THEN 'high' ELSE 'medium' END AS severity,
  count(*) AS n FROM s GROUP BY 1""")
def severity_counts(spark, folder):
    events = with_matched_rules(sec_events(spark, folder), load_rules()).where(F.size("matchedRules") > 0)
    severity = alert_severity(F.col("matchedRules"), overall_score(F.array(rule_score(F.col("matchedRules")))))
    return events.groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))


@query("q_rules_by_tag", f"""
WITH {sec()}, {rule_values()}, {matched()}
SELECT id, count(*) AS n FROM (SELECT unnest(hits) AS h FROM ruled) JOIN rules ON ordinal = h
WHERE list_contains(tags, 'aws') GROUP BY id""")
def rules_by_tag(spark, folder):
    tagged = by_tag(load_rules(), "aws")
    events = with_matched_rules(sec_events(spark, folder), tagged)
    return events.select(F.explode("matchedRules").alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.count("*").alias("n"))


@query("q_rule_stats", f"""
WITH {sec()}, {rule_values()}, {matched()}, c AS (SELECT h, count(*) AS n FROM (SELECT unnest(hits) AS h FROM ruled) GROUP BY h)
SELECT id, rsev AS severity, true AS enabled, len(tags) AS n_tags, coalesce(n, 0) AS matches FROM rules LEFT JOIN c ON h = ordinal""")
def rule_stats(spark, folder):
    rules = load_rules()
    events = with_matched_rules(sec_events(spark, folder), rules)
    hits = events.select(F.explode("matchedRules").alias("r")).groupBy(F.col("r.id").alias("id")).agg(F.count("*").alias("m"))
    return rules_frame(spark, rules).join(hits, "id", "left").select(
        "id", "severity", "enabled", F.size("tags").alias("n_tags"), F.coalesce("m", F.lit(0)).alias("matches"))


# --- a large pack ---------------------------------------------------------------------------

#: Rules of the generated pack; the same conditions stand below in SQL, by the rule's number.
LARGE_PACK = 1500


def large_pack() -> list[Rule]:
    """Narrow rules of every kind of access, among them some that no index can file."""
    def conditions(n):
        return [
            [("sourceProvider", "equals", "aws"), ("actor.username", "equals", f"user_{n}")],
            [("actor.username", "in", [f"user_{n}", f"user_{n + 1}"]), ("resource.resourceId", "contains", f"-{n % 25}")],
            [("eventName", "regex", "^(Delete|Terminate).*s?$"), ("network.bytesSent", "greater_than", n * 1_000_000), ("network.source_port", "equals", 1024 + n % 100)],
            [("eventName", "contains", "Policy"), ("actor.ipAddress", "equals", f"203.0.113.{n % 20}"), ("actor.username", "contains", f"_{n}")],
            [("requestParameters.mfaUsed", "equals", n % 2 == 0), ("risk_score", "greater_than", 0.94 + n / 30_000), ("sourceProvider", "not_equals", "gcp")],
        ][n % 5 if n % 100 != 4 else 4]

    return [Rule(id=f"large-{n}", name=f"large {n}", conditions=tuple(Condition(*c) for c in conditions(n)))
            for n in range(LARGE_PACK) if n % 5 != 4 or n % 100 == 4]


@query("q_rule_index", f"""
WITH {sec()}, hits AS (SELECT eventId, n FROM sec, range({LARGE_PACK}) r(n) WHERE CASE
  WHEN n % 5 = 0 THEN provider = 'aws' AND username = 'user_' || n
  WHEN n % 5 = 1 THEN username IN ('user_' || n, 'user_' || (n + 1)) AND contains(resource, '-' || (n % 25))
  WHEN n % 5 = 2 THEN regexp_matches(name, '^(Delete|Terminate).*s?$') AND bytes > n * 1000000 AND k + 1024 = 1024 + n % 100
  WHEN n % 5 = 3 THEN contains(name, 'Policy') AND ip = '203.0.113.' || (n % 20) AND contains(username, '_' || n)
  WHEN n % 100 = 4 THEN mfa = (n % 2 = 0) AND coalesce(risk > 0.94::DOUBLE + n::DOUBLE / 30000::DOUBLE, false) AND provider <> 'gcp' ELSE false END)
SELECT eventId, count(*) AS n_rules, string_agg('large-' || n, '|' ORDER BY n) AS rules FROM hits GROUP BY 1""")
def rule_index(spark, folder):
    judged = with_matched_rules(sec_events(spark, folder), large_pack())
    return judged.where(F.size("matchedRules") > 0).select(
        "eventId", F.size("matchedRules").cast("long").alias("n_rules"), F.array_join("matchedRules.id", "|").alias("rules"))
