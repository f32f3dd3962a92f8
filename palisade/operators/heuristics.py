"""Behavioural heuristics over unified events.

Row-local checks are columns. History checks (frequency, failed logins, first-seen country,
action and accessor) run on narrow projections and yield sparse *signals* that are matched
back to the events once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import user_key
from palisade.operators.firstseen import first_pairs, merge_pairs, newcomers, unseen_lookups
from palisade.operators.joins import lookup_join
from palisade.operators.trailing import trailing_hits
from palisade.schema import EVENT_KEY
from palisade.session import checkpoint_root, land

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000

# Thresholds, divisors and scores of the heuristics.
USER_WINDOW_US, USER_FLOOR, USER_FULL = 5 * MINUTE_US, 20, 50.0
IP_WINDOW_US, IP_FLOOR, IP_FULL = 5 * MINUTE_US, 30, 60.0
LOGIN_WINDOW_US, LOGIN_MINIMUM, LOGIN_FULL = 10 * MINUTE_US, 5, 10.0
NEW_LOCATION_SCORE = 0.6
KNOWN_ACTIONS, UNUSUAL_ACTION_SCORE = 10, 0.5
KNOWN_ACCESSORS, UNUSUAL_ACCESSOR_SCORE = 5, 0.6
WEEKEND_SCORE, NIGHT_SCORE, EARLY_SCORE = 0.3, 0.4, 0.6
SENSITIVE_KEYWORDS = [
    "secret", "key", "password", "credential", "token", "admin", "root", "delete", "destroy", "terminate",
]
SENSITIVE_SCORE = 0.7
CRITICAL_TAGS = ["high", "critical"]
CRITICAL_SCORE = 0.6

#: What a signal is joined back on: ids can repeat, so what the checks look at is part of the key.
SIGNAL_KEY = [*EVENT_KEY, "mark"]


def signal_mark() -> Column:
    """Tells events of one id apart by all that a history check reads; events equal in it get equal signals."""
    return F.xxhash64("eventName", "eventType", "outcome", "actor.username", "actor.userId", "actor.ipAddress",
                      "actor.geo_location.country", "resource.resourceId")


def _narrow(events: DataFrame) -> DataFrame:
    return events.select(
        *EVENT_KEY,
        signal_mark().alias("mark"),
        "eventName",
        "eventType",
        "outcome",
        F.nullif(F.col("actor.username"), F.lit("")).alias("username"),
        F.nullif(F.col("actor.ipAddress"), F.lit("")).alias("ip"),
        user_key().alias("user"),
        F.nullif(F.col("actor.geo_location.country"), F.lit("")).alias("country"),
        F.nullif(F.col("resource.resourceId"), F.lit("")).alias("resourceId"),
        F.unix_micros("timestamp").alias("t_us"),
    )


# --- history checks: sparse tables keyed by the event ---------------------------------------


def user_frequency(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where("username is not null").select("username", "eventName", "t_us", *SIGNAL_KEY)
    return trailing_hits(rows, ["username", "eventName"], USER_WINDOW_US, USER_FLOOR, SIGNAL_KEY, "user_count")


def ip_frequency(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where("ip is not null").select("ip", "eventName", "t_us", *SIGNAL_KEY)
    return trailing_hits(rows, ["ip", "eventName"], IP_WINDOW_US, IP_FLOOR, SIGNAL_KEY, "ip_count")


def failed_logins(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where(
        "username is not null and eventType = 'authentication' and outcome = 'failure'"
    ).select("username", "t_us", *SIGNAL_KEY)
    return trailing_hits(rows, ["username"], LOGIN_WINDOW_US, LOGIN_MINIMUM - 1, SIGNAL_KEY, "failed_count")


PAIR_CARRY = ["sourceProvider", "eventType", "mark"]


def country_pairs(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where("username is not null and country is not null")
    return first_pairs(rows.withColumn("user", F.col("username")), "user", "country", PAIR_CARRY)


def action_pairs(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where("username is not null")
    return first_pairs(rows.withColumn("user", F.col("username")), "user", "eventName", PAIR_CARRY)


def accessor_pairs(events: DataFrame) -> DataFrame:
    rows = _narrow(events).where("username is not null and resourceId is not null")
    return first_pairs(rows, "resourceId", "username", PAIR_CARRY)


def _with_baseline(pairs: DataFrame, baseline: DataFrame | None, owner: str, item: str) -> DataFrame:
    """The pairs table is far smaller than the events and read several times, so it is landed."""
    return land(pairs if baseline is None else merge_pairs(baseline, pairs, owner, item))


def _pair_event(pairs: DataFrame, *keep: str) -> DataFrame:
    return pairs.select(*[F.col(f"first.{c}").alias(c) for c in [*SIGNAL_KEY, "eventType"]], *keep)


def _since(hits: DataFrame, since: Column | None) -> DataFrame:
    return hits if since is None else hits.where(F.col("timestamp") >= since)


def new_locations(events: DataFrame, baseline: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """Authentication from a country the user was never seen in, once some country is known.

    With a ``baseline`` of earlier pairs only events from ``since`` on are reported."""
    pairs = _with_baseline(country_pairs(events), baseline, "user", "country")
    hits = _pair_event(newcomers(pairs, "user", "country", 1), "user", "country")
    readers = _narrow(events).where("username is null and user is not null and country is not null")
    late = unseen_lookups(readers, pairs, "user", "country", 1).select(*hits.columns)
    return _since(hits.unionByName(late).where("eventType = 'authentication'"), since).select(
        *SIGNAL_KEY, F.col("country").alias("new_country"))


def unusual_actions(events: DataFrame, baseline: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """An action the user never took, once more than ten actions are known."""
    pairs = _with_baseline(action_pairs(events), baseline, "user", "eventName")
    hits = _pair_event(newcomers(pairs, "user", "eventName", KNOWN_ACTIONS + 1), "user", "eventName")
    readers = _narrow(events).where("username is null and user is not null")
    late = unseen_lookups(readers, pairs, "user", "eventName", KNOWN_ACTIONS + 1).select(*hits.columns)
    return _since(hits.unionByName(late), since).select(*SIGNAL_KEY, F.col("eventName").alias("new_action"))


def unusual_accessors(events: DataFrame, baseline: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """A user new to a resource that more than five users are known to use."""
    pairs = _with_baseline(accessor_pairs(events), baseline, "resourceId", "username")
    hits = _pair_event(newcomers(pairs, "resourceId", "username", KNOWN_ACCESSORS + 1), "username")
    return _since(hits, since).select(*SIGNAL_KEY, F.col("username").alias("new_accessor"))


SIGNAL_COLUMNS = {
    "user_count": "bigint", "ip_count": "bigint", "failed_count": "bigint",
    "new_country": "string", "new_action": "string", "new_accessor": "string",
}


def combine_signals(tables: list[DataFrame]) -> DataFrame:
    """One row per event that raised any history signal."""
    padded = [
        t.select(*SIGNAL_KEY, *[
            (F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(c)
            for c, kind in SIGNAL_COLUMNS.items()
        ])
        for t in tables
    ]
    merged = reduce(DataFrame.unionByName, padded)
    return merged.groupBy(*SIGNAL_KEY).agg(*[F.max(c).alias(c) for c in SIGNAL_COLUMNS])


CHECKS = [user_frequency, ip_frequency, failed_logins, new_locations, unusual_actions, unusual_accessors]


def history_signals(events: DataFrame) -> DataFrame:
    """All history checks. ``events`` should be a stored table: each check scans its few columns.

    The checks do not depend on each other, so their preparing jobs are submitted side by side."""
    checkpoint_root(events.sparkSession)
    with ThreadPoolExecutor(len(CHECKS)) as pool:
        tables = list(pool.map(lambda check: check(events), CHECKS))
    return land(combine_signals(tables))


# --- row-local checks -----------------------------------------------------------------------


def weekend() -> Column:
    return F.weekday("timestamp") >= 5


def night() -> Column:
    return (F.hour("timestamp") >= 22) | (F.hour("timestamp") < 6)


def very_early() -> Column:
    return (F.hour("timestamp") >= 2) & (F.hour("timestamp") < 5)


def sensitive_keyword(name: Column) -> Column:
    """First listed keyword found in the lower-cased name; null when none is."""
    lowered = F.lower(name)
    found = F.lit(None).cast("string")
    for keyword in reversed(SENSITIVE_KEYWORDS):
        found = F.when(lowered.contains(keyword), F.lit(keyword)).otherwise(found)
    return found


def critical_resource() -> Column:
    tag = F.try_element_at(F.col("resource.tags"), F.lit("criticality"))
    return F.coalesce(tag.isin(*CRITICAL_TAGS), F.lit(False))


def _entry(condition: Column, text: Column, score: Column) -> Column:
    return F.when(condition, F.struct(text.alias("text"), score.cast("double").alias("score")))


def time_entries() -> list[Column]:
    hour_text = F.concat(F.lit("Activity during unusual hours ("),
                         F.lpad(F.hour("timestamp").cast("string"), 2, "0"), F.lit(":00)"))
    return [
        _entry(weekend(), F.lit("Activity during weekend"), F.lit(WEEKEND_SCORE)),
        _entry(night(), hour_text, F.lit(NIGHT_SCORE)),
        _entry(very_early(), F.lit("Activity during very early morning hours"), F.lit(EARLY_SCORE)),
    ]


def sensitive_entries() -> list[Column]:
    keyword = sensitive_keyword(F.col("eventName"))
    return [
        _entry(keyword.isNotNull(), F.concat(F.lit("Sensitive operation detected: "), keyword), F.lit(SENSITIVE_SCORE)),
        _entry(critical_resource(), F.lit("Access to high-criticality resource"), F.lit(CRITICAL_SCORE)),
    ]


def _saturating(count: str, full: float) -> Column:
    return F.least(F.col(count) / F.lit(full), F.lit(1.0))


def frequency_entries() -> list[Column]:
    return [
        _entry(F.col("user_count").isNotNull(),
               F.concat(F.lit("High frequency of "), F.col("eventName"), F.lit(" by "), F.col("actor.username")),
               _saturating("user_count", USER_FULL)),
        _entry(F.col("ip_count").isNotNull(),
               F.concat(F.lit("High frequency from IP "), F.col("actor.ipAddress")),
               _saturating("ip_count", IP_FULL)),
    ]


def login_entries() -> list[Column]:
    return [
        _entry(F.col("failed_count").isNotNull(),
               F.concat(F.lit("Multiple failed login attempts for "), F.col("actor.username")),
               _saturating("failed_count", LOGIN_FULL)),
        _entry(F.col("new_country").isNotNull(),
               F.concat(F.lit("Login from new location: "), F.col("new_country")), F.lit(NEW_LOCATION_SCORE)),
    ]


def behaviour_entries() -> list[Column]:
    return [
        _entry(F.col("new_action").isNotNull(),
               F.concat(F.lit("Unusual action for user: "), F.col("new_action")), F.lit(UNUSUAL_ACTION_SCORE)),
        _entry(F.col("new_accessor").isNotNull(),
               F.concat(F.lit("Unusual user accessing resource: "), F.col("new_accessor")),
               F.lit(UNUSUAL_ACCESSOR_SCORE)),
    ]


def heuristic_result(entries: Column) -> Column:
    """{isSuspicious, indicators, score}: indicators in check order, the highest score."""
    return F.struct(
        (F.size(entries) > 0).alias("isSuspicious"),
        F.transform(entries, lambda e: e["text"]).alias("indicators"),
        F.coalesce(F.array_max(F.transform(entries, lambda e: e["score"])), F.lit(0.0)).alias("score"),
    )


def with_heuristics(events: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Add the ``heuristic`` struct; without ``signals`` only the row-local checks run."""
    if signals is None:
        entries = F.array_compact(F.array(*time_entries(), *sensitive_entries()))
        joined = events
    else:
        joined = lookup_join(events.withColumn("mark", signal_mark()), signals, SIGNAL_KEY).drop("mark")
        entries = F.array_compact(F.array(
            *frequency_entries(), *login_entries(), *time_entries(), *behaviour_entries(), *sensitive_entries()
        ))
    return joined.withColumn("heuristic_entries", entries).withColumn(
        "heuristic", heuristic_result(F.col("heuristic_entries"))
    ).drop("heuristic_entries", *(SIGNAL_COLUMNS if signals is not None else ()))


def without_heuristics(events: DataFrame) -> DataFrame:
    """The ``heuristic`` struct of an engine that is switched off."""
    return events.withColumn("heuristic", heuristic_result(F.array().cast("array<struct<text:string,score:double>>")))


# --- baselines -----------------------------------------------------------------------------


def user_baseline(events: DataFrame) -> DataFrame:
    """Per user: sorted actions, sorted countries, events per hour of day.

    Actions and countries are closed vocabularies and hours are 24, so the sets stay small; the
    per-user rows are reduced to distinct values before they are gathered."""
    rows = _narrow(events).where("username is not null")
    facts = rows.select(
        F.col("username").alias("user"), F.col("eventName").alias("action"), "country", F.hour("timestamp").alias("hour")
    ).groupBy("user", "action", "country", "hour").agg(F.count("*").alias("n"))
    hours = [F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)).alias(f"h{h}") for h in range(24)]
    return facts.groupBy("user").agg(
        F.array_sort(F.collect_set("action")).alias("actions"),
        F.array_sort(F.collect_set("country")).alias("countries"),
        F.sum("n").alias("n_events"),
        *hours,
    ).select("user", "actions", "countries", "n_events", F.array(*[f"h{h}" for h in range(24)]).alias("hours"))


def resource_baseline(events: DataFrame) -> DataFrame:
    """Per resource: accesses and distinct users. The users themselves stay one row per pair
    (``accessor_pairs``), because a popular resource may have any number of them."""
    rows = _narrow(events).where("resourceId is not null")
    return (
        rows.groupBy("resourceId", "username").agg(F.count("*").alias("n"))
        .groupBy("resourceId")
        .agg(F.sum("n").alias("access_count"), F.count("username").alias("n_users"),
             F.min("username").alias("first_user"), F.max("username").alias("last_user"))
    )


# --- statistical checks ---------------------------------------------------------------------


def period_counts(events: DataFrame, period_us: int) -> DataFrame:
    """(user, period, n): event counts per user and fixed period."""
    rows = _narrow(events).where("username is not null")
    period = ((F.col("t_us") - F.pmod(F.col("t_us"), F.lit(period_us))) / F.lit(period_us)).cast("long")
    return rows.groupBy(F.col("username").alias("user"), period.alias("period")).agg(F.count("*").alias("n"))


def rolling_deviation(counts: DataFrame, periods: int) -> DataFrame:
    """Mean and population deviation of the ``periods`` preceding periods, empty ones as 0.

    Sums are of whole numbers, so the result does not depend on the order of addition."""
    before = Window.partitionBy("user").orderBy("period").rangeBetween(-periods, -1)
    total, squares = F.sum("n").over(before), F.sum(F.col("n") * F.col("n")).over(before)
    return (
        counts.withColumn("s1", total).withColumn("s2", squares)
        .where("s1 is not null")
        .withColumn("mean", F.col("s1") / F.lit(float(periods)))
        .withColumn("variance", (F.lit(periods) * F.col("s2") - F.col("s1") * F.col("s1"))
                    / F.lit(float(periods * periods)))
        .withColumn("sd", F.sqrt("variance"))
    )


def zscore_outliers(events: DataFrame, threshold: float = 3.0, hours: int = 24) -> DataFrame:
    scored = rolling_deviation(period_counts(events, HOUR_US), hours)
    return (
        scored.where("sd > 0")
        .withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd"))
        .where(F.abs("z") > threshold)
        .select("user", F.timestamp_micros(F.col("period") * HOUR_US).alias("hour"), "n", F.round("z", 6).alias("z"))
    )


def baseline_deviations(events: DataFrame, threshold: float = 2.5, days: int = 7) -> DataFrame:
    day_us = 24 * HOUR_US
    scored = rolling_deviation(period_counts(events, day_us), days)
    return (
        scored.where("sd > 0")
        .withColumn("deviation", F.abs(F.col("n") - F.col("mean")) / F.col("sd"))
        .where(F.col("deviation") > threshold)
        .select("user", F.timestamp_micros(F.col("period") * day_us).alias("day"), "n",
                F.round("deviation", 6).alias("deviation"))
    )
