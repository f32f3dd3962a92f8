"""DuckDB statements of the derived tables and of the whole detection, for the SQL checks.

Written on its own, with plain window functions and recursion, not from the Spark code; only
names and texts of the default rules come from the rule files.
"""

from __future__ import annotations

from palisade.operators.rules import load_rules
from palisade.plans.fixed_forest import walk_sql

BASE = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS us FROM events
)"""

TRUE_NAMES = """CASE
    WHEN event_type IN ('signup', 'error') THEN 'ConsoleLogin'
    WHEN event_type = 'click' THEN (['GetObject','ListBuckets','GetSecretValue','DescribeInstances','GetPasswordData','ListUsers'])[1 + k % 6]
    WHEN event_type = 'view' THEN (['DescribeVpcs','GetBucketPolicy','ListKeys','DescribeTrails'])[1 + k % 4]
    ELSE (['CreateAccessKey','DeleteTrail','AttachUserPolicy','AuthorizeSecurityGroupIngress','TerminateInstances','UpdateFunction','DeleteBucket','PutRolePolicy'])[1 + k % 8]
  END"""
BURST_NAMES = """CASE event_type WHEN 'signup' THEN 'ConsoleLogin' WHEN 'error' THEN 'ConsoleLogin'
    WHEN 'click' THEN 'GetObject' WHEN 'view' THEN 'DescribeInstances' ELSE 'CreateAccessKey' END"""


def classified(name: str, tiers: list[tuple[str, list[str]]]) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"lower({name}) LIKE '%{f}%'" for f in fragments) + f" THEN '{kind}'"
        for kind, fragments in tiers
    )
    return f"CASE {whens} ELSE 'unknown' END"


AWS_TIERS = [("authentication", ["login", "authenticate"]), ("authorization", ["authorize", "policy"]),
             ("configuration_change", ["create", "delete", "update"]), ("resource_access", ["get", "list", "describe"])]
GCP_TIERS = [AWS_TIERS[0], AWS_TIERS[2], ("resource_access", ["get", "list"])]


def sec(burst: bool = False) -> str:
    """CTEs ``base`` and ``sec``: the derived event stream, flat."""
    us = "(1704067200000000 + ((us - 1704067200000000) // 1440))" if burst else "us"
    user, address = ("user_id % 10", "user_id % 6") if burst else ("user_id", "user_id % 20")
    return BASE + f""",
named AS (SELECT *, {BURST_NAMES if burst else TRUE_NAMES} AS name, (['aws','azure','gcp'])[1 + event_id % 3] AS provider FROM base),
sec AS (
  SELECT 'evt-' || event_id AS eventId, event_id, k, {us} AS t_us, make_timestamp({us}) AS ts, provider,
    CASE WHEN k = 99 THEN 'guardduty' WHEN provider = 'aws' THEN 'cloudtrail'
         WHEN provider = 'azure' THEN 'activityLogs' ELSE 'gcp_audit_logs' END AS service,
    name,
    CASE provider WHEN 'aws' THEN {classified('name', AWS_TIERS)}
                  WHEN 'gcp' THEN {classified('name', GCP_TIERS)}
                  ELSE 'administrative_action' END AS type,
    CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
    CASE WHEN k >= 95 THEN 'critical' WHEN k >= 85 THEN 'high' WHEN k >= 70 THEN 'medium' WHEN k >= 50 THEN 'low' ELSE 'info' END AS severity,
    'user_' || ({user}) AS username,
    CASE WHEN user_id % 50 = 0 THEN 'Root' ELSE 'IAMUser' END AS usertype,
    '203.0.113.' || ({address}) AS ip,
    (['US','CA','GB','DE','FR','RU','CN','BR'])[1 + (user_id + CASE WHEN event_id % 53 = 0 THEN 3 ELSE 0 END) % 8] AS country,
    'res-' || (k % 25) AS resource,
    CASE WHEN k % 25 = 7 THEN 'high' ELSE 'low' END AS criticality,
    '198.51.100.' || (k % 10) AS sip, '192.0.2.' || (k % 20) AS dip,
    CAST(floor(value * 100000000) AS BIGINT) AS bytes,
    CASE WHEN k >= 95 THEN CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) END AS risk,
    k % 2 = 0 AS mfa
  FROM named
)"""


RULES = {
    1: "provider = 'aws' AND usertype = 'Root' AND name NOT IN ('GetAccountSummary','ListAccountAliases')",
    2: "type = 'authentication' AND outcome = 'failure'",
    3: "country NOT IN ('US','CA','GB','DE','FR') AND country IS NOT NULL",
    4: "regexp_matches(name, 'PutUserPolicy|PutRolePolicy|AttachUserPolicy|AttachRolePolicy|CreateAccessKey')",
    5: "regexp_matches(name, 'AuthorizeSecurityGroupIngress|RevokeSecurityGroupIngress') AND provider = 'aws'",
    6: "bytes > 10000000000",
    7: "regexp_matches(name, 'Delete|Terminate|Destroy') AND type = 'configuration_change'",
    8: "name = 'ConsoleLogin' AND NOT mfa AND outcome = 'success'",
    9: "name = 'CreateAccessKey' AND provider = 'aws'",
    10: "service = 'guardduty' AND severity IN ('high','critical')",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_values() -> str:
    """CTE ``rules(ordinal, id, name, severity, description, tags)``."""
    rows = ", ".join(
        f"({i}, {quoted(r.id)}, {quoted(r.name)}, {quoted(r.severity)}, {quoted(r.description)}, "
        f"[{', '.join(quoted(t) for t in r.tags)}])"
        for i, r in enumerate(load_rules(), start=1)
    )
    return f"rules(ordinal, id, rule, rsev, rdesc, tags) AS (VALUES {rows})"


def matched() -> str:
    """CTE ``ruled``: ``sec`` plus ``hits``, the ordinals of the matching rules."""
    cases = ", ".join(f"CASE WHEN {p} THEN {n} END" for n, p in RULES.items())
    return f"ruled AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS hits FROM sec)"


def picked(column: str) -> str:
    """List over rules of one text column, in catalogue order, as an indexable literal."""
    attribute = {"id": "id", "name": "name", "severity": "severity", "description": "description"}[column]
    return "[" + ", ".join(quoted(getattr(r, attribute)) for r in load_rules()) + "]"


KEYWORDS = ["secret", "key", "password", "credential", "token", "admin", "root", "delete", "destroy", "terminate"]
KEYWORD = "CASE " + " ".join(f"WHEN contains(lower(name), '{w}') THEN '{w}'" for w in KEYWORDS) + " END"

HISTORY = """
hist AS (
  SELECT *,
    count(*) OVER (PARTITION BY username, name ORDER BY t_us RANGE BETWEEN 299999999 PRECEDING AND 1 PRECEDING) AS n_user,
    count(*) OVER (PARTITION BY ip, name ORDER BY t_us RANGE BETWEEN 299999999 PRECEDING AND 1 PRECEDING) AS n_ip,
    CASE WHEN type = 'authentication' AND outcome = 'failure' THEN
      sum(CASE WHEN type = 'authentication' AND outcome = 'failure' THEN 1 ELSE 0 END)
        OVER (PARTITION BY username ORDER BY t_us RANGE BETWEEN 599999999 PRECEDING AND 1 PRECEDING) END AS n_fail,
    row_number() OVER (PARTITION BY username, country ORDER BY t_us, eventId) AS c_rank,
    row_number() OVER (PARTITION BY username, name ORDER BY t_us, eventId) AS a_rank,
    row_number() OVER (PARTITION BY resource, username ORDER BY t_us, eventId) AS r_rank
  FROM ruled
),
seen AS (
  SELECT *,
    sum(CASE WHEN c_rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY t_us, eventId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_known,
    sum(CASE WHEN a_rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY t_us, eventId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a_known,
    sum(CASE WHEN r_rank = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY resource ORDER BY t_us, eventId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r_known
  FROM hist
),
flags AS (
  SELECT *, n_user > 20 AS h1, n_ip > 30 AS h2, coalesce(n_fail >= 5, false) AS h3,
    type = 'authentication' AND c_rank = 1 AND coalesce(c_known, 0) > 0 AS h4,
    a_rank = 1 AND coalesce(a_known, 0) > 10 AS h5,
    r_rank = 1 AND coalesce(r_known, 0) > 5 AS h6
  FROM seen
)"""
NO_HISTORY = """
flags AS (
  SELECT *, 0 AS n_user, 0 AS n_ip, 0 AS n_fail, false AS h1, false AS h2, false AS h3, false AS h4, false AS h5, false AS h6
  FROM ruled
)"""


TYPES = ["authentication", "authorization", "resource_access", "network_traffic", "configuration_change", "data_access",
         "security_alert", "administrative_action"]
FEATURES_OF = [
    "CAST(hour(ts) AS DOUBLE) AS hour", "CAST(isodow(ts) - 1 AS DOUBLE) AS weekday",
    *[f"CAST(type = '{t}' AS DOUBLE) AS is_{t}" for t in TYPES],
    "CAST(list_position(['info','low','medium','high','critical'], severity) - 1 AS DOUBLE) AS severity",
    "CAST(outcome = 'success' AS DOUBLE) AS success", "CAST(k + 1024 AS DOUBLE) AS source_port",
    "CAST(CASE WHEN k % 2 = 0 THEN 443 ELSE 22 END AS DOUBLE) AS destination_port", "CAST(bytes AS DOUBLE) AS bytes_sent",
    "CAST(0 AS DOUBLE) AS bytes_received", "coalesce(risk, 0.0) AS risk", "CAST(0 AS DOUBLE) AS indicators",
]
FEATURE_SQL = ", ".join(FEATURES_OF)


#: What the third engine finds in no event.
NO_THIRD = "third AS (SELECT eventId, 0.0::DOUBLE AS raw, 0.0::DOUBLE AS ascore, false AS anom FROM sec)"


def detected(burst: bool = False, history: bool = True, third: bool = True) -> str:
    """CTE chain ending in ``det``: hits, indicators, hscore, methods, overall, threat per event. ``third``: with the walk
    through the fixed forest."""
    walked = walk_sql([e.rsplit(" AS ", 1)[0] for e in FEATURES_OF], "sec") if third else NO_THIRD
    return f"""{sec(burst)},
{matched()},
{walked},
{HISTORY if history else NO_HISTORY},
entries AS (
  SELECT *, list_filter([
    CASE WHEN h1 THEN {{'t': 'High frequency of ' || name || ' by ' || username, 's': least(n_user / CAST(50 AS DOUBLE), 1.0::DOUBLE)}} END,
    CASE WHEN h2 THEN {{'t': 'High frequency from IP ' || ip, 's': least(n_ip / CAST(60 AS DOUBLE), 1.0::DOUBLE)}} END,
    CASE WHEN h3 THEN {{'t': 'Multiple failed login attempts for ' || username, 's': least(n_fail / CAST(10 AS DOUBLE), 1.0::DOUBLE)}} END,
    CASE WHEN h4 THEN {{'t': 'Login from new location: ' || country, 's': 0.6::DOUBLE}} END,
    CASE WHEN isodow(ts) >= 6 THEN {{'t': 'Activity during weekend', 's': 0.3::DOUBLE}} END,
    CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN {{'t': 'Activity during unusual hours (' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00)', 's': 0.4::DOUBLE}} END,
    CASE WHEN hour(ts) >= 2 AND hour(ts) < 5 THEN {{'t': 'Activity during very early morning hours', 's': 0.6::DOUBLE}} END,
    CASE WHEN h5 THEN {{'t': 'Unusual action for user: ' || name, 's': 0.5::DOUBLE}} END,
    CASE WHEN h6 THEN {{'t': 'Unusual user accessing resource: ' || username, 's': 0.6::DOUBLE}} END,
    CASE WHEN {KEYWORD} IS NOT NULL THEN {{'t': 'Sensitive operation detected: ' || {KEYWORD}, 's': 0.7::DOUBLE}} END,
    CASE WHEN criticality IN ('high','critical') THEN {{'t': 'Access to high-criticality resource', 's': 0.6::DOUBLE}} END
  ], lambda x: x IS NOT NULL) AS es FROM flags
),
engines AS (
  SELECT *, list_transform(es, lambda e: e.t) AS indicators, coalesce(list_max(list_transform(es, lambda e: e.s)), 0.0) AS hscore,
    list_max(list_transform(hits, lambda h: CASE {picked('severity')}[h]
      WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.8::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE
      WHEN 'low' THEN 0.4::DOUBLE WHEN 'info' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END)) AS rscore,
    list_filter([CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'Activity during unusual hours' END, CASE WHEN risk > 0.7 THEN 'High risk score' END],
      lambda x: x IS NOT NULL) AS odd
  FROM entries JOIN third USING (eventId)
),
fused AS (
  SELECT *, CASE WHEN len(odd) > 0 THEN odd ELSE ['Anomalous feature combination'] END AS areasons,
    list_filter([CASE WHEN len(hits) > 0 THEN rscore END, CASE WHEN anom THEN ascore END, CASE WHEN len(es) > 0 THEN hscore END], lambda x: x IS NOT NULL) AS scores
  FROM engines
),
det AS (
  SELECT *, len(hits) > 0 AS by_rules, len(es) > 0 AS by_heur,
    list_filter([CASE WHEN len(hits) > 0 THEN 'rules' END, CASE WHEN anom THEN 'anomaly' END, CASE WHEN len(es) > 0 THEN 'heuristic' END],
      lambda x: x IS NOT NULL) AS methods,
    len(scores) > 0 AS threat,
    CASE WHEN len(scores) > 0 THEN list_max(scores) * 0.6::DOUBLE + (list_sum(scores) / len(scores)) * 0.4::DOUBLE ELSE 0.0::DOUBLE END AS overall
  FROM fused
)"""


def alerted(burst: bool = False, history: bool = True, third: bool = True) -> str:
    """CTE chain ending in ``alert``: one row per threat with texts and fingerprint."""
    names, descriptions, severities = picked("name"), picked("description"), picked("severity")
    return f"""{detected(burst, history, third)},
texts AS (
  SELECT *, 'alert_' || eventId || '_' || CAST(t_us // 1000000 AS VARCHAR) AS alertId,
    CASE WHEN len(hits) > 0 THEN {names}[hits[1]] WHEN anom THEN 'Anomalous Activity Detected: ' || name
      ELSE 'Suspicious Activity Detected: ' || name END AS title,
    CASE WHEN len(hits) > 0 THEN
      CASE WHEN len(list_filter(hits, lambda h: {severities}[h] = 'critical')) > 0 THEN 'critical'
           WHEN len(list_filter(hits, lambda h: {severities}[h] = 'high')) > 0 THEN 'high'
           WHEN len(list_filter(hits, lambda h: {severities}[h] = 'medium')) > 0 THEN 'medium'
           WHEN len(list_filter(hits, lambda h: {severities}[h] = 'low')) > 0 THEN 'low' ELSE 'info' END
      WHEN overall >= 0.9 THEN 'critical' WHEN overall >= 0.7 THEN 'high' WHEN overall >= 0.5 THEN 'medium'
      WHEN overall >= 0.3 THEN 'low' ELSE 'info' END AS asev,
    array_to_string(list_concat(
      CASE WHEN len(hits) > 0 THEN list_concat(list_concat(['**Matched Rules:**'],
        list_transform(hits, lambda h: '- ' || {names}[h] || ': ' || {descriptions}[h])), ['']) ELSE CAST([] AS VARCHAR[]) END,
      list_concat(list_concat(
      CASE WHEN anom THEN list_concat(list_concat(['**Anomaly Detection:**'],
        list_transform(areasons, lambda i: '- ' || i)), ['']) ELSE CAST([] AS VARCHAR[]) END,
      CASE WHEN len(es) > 0 THEN list_concat(list_concat(['**Heuristic Analysis:**'],
        list_transform(indicators, lambda i: '- ' || i)), ['']) ELSE CAST([] AS VARCHAR[]) END),
      ['**Event:** ' || name, '**Source:** ' || provider || '/' || service,
       '**Time:** ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC', '**Actor:** ' || username, '**IP Address:** ' || ip])), chr(10)) AS description,
    list_sort(list_distinct(list_concat(indicators, CASE WHEN anom THEN areasons ELSE CAST([] AS VARCHAR[]) END))) AS inds
  FROM det WHERE threat
),
alert AS (
  SELECT *, substr(sha256(title || chr(31) || asev || chr(31) || array_to_string(list_sort(methods), chr(30)) || chr(31)
    || array_to_string(inds[1:5], chr(30))), 1, 16) AS fp
  FROM texts
)"""


def deduplicated(burst: bool = False, history: bool = True, window_us: int = 3_600_000_000) -> str:
    """CTE chain ending in ``dd``: every alert with the anchor of its window and ``dup``."""
    return f"""RECURSIVE {alerted(burst, history)},
chain AS (
  SELECT fp, min(t_us) AS a FROM alert GROUP BY fp
  UNION ALL
  SELECT c.fp, (SELECT min(x.t_us) FROM alert x WHERE x.fp = c.fp AND x.t_us >= c.a + {window_us}) AS a
  FROM chain c WHERE c.a IS NOT NULL
),
placed AS (
  SELECT al.*, c.a AS anchor_us,
    row_number() OVER (PARTITION BY al.fp, c.a ORDER BY al.t_us, al.alertId) AS pos
  FROM alert al ASOF JOIN (SELECT * FROM chain WHERE a IS NOT NULL) c ON al.fp = c.fp AND al.t_us >= c.a
),
dd AS (SELECT *, pos > 1 AS dup FROM placed)"""


def throttled(limit: int, window_us: int, source: str) -> str:
    """CTEs ending in ``thr``: the rows of ``source`` (alertId, t_us) with ``thr``."""
    return f"""
counts AS (SELECT t_us AS t, count(*) AS n, row_number() OVER (ORDER BY t_us) AS i FROM {source} GROUP BY t_us),
admit AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(t BIGINT, k BIGINT)[]) AS h
  UNION ALL
  SELECT i, t, k, list_append(h, {{'t': t, 'k': k}}) FROM (
    SELECT c.i, c.t,
      greatest(0, least(c.n, {limit} - coalesce(CAST(list_sum(list_transform(list_filter(a.h, lambda y: y.t > c.t - {window_us}), lambda y: y.k)) AS BIGINT), 0))) AS k,
      list_filter(a.h, lambda y: y.t > c.t - {window_us} AND y.k > 0) AS h
    FROM admit a JOIN counts c ON c.i = a.i + 1
  )
),
thr AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.t_us ORDER BY s.alertId) > d.k AS throttled
  FROM {source} s JOIN admit d ON d.t = s.t_us AND d.i > 0
)"""
