"""History checks: thresholds, window edges, and brute force on random events."""

import random

import pytest
from helpers import MINUTE, events, ids

from palisade.operators import heuristics as he
from palisade.operators.firstseen import first_pairs, kth_first
from palisade.operators.trailing import trailing_instants
from palisade.session import land


def counts(df, column):
    return {r["eventId"]: r[column] for r in df.collect()}


def test_user_frequency_threshold(spark):
    rows = [dict(username="u", offset_us=i) for i in range(22)]
    assert counts(he.user_frequency(events(spark, rows)), "user_count") == {"e00021": 21}


def test_ip_frequency_threshold(spark):
    rows = [dict(ip="1.2.3.4", offset_us=i) for i in range(32)]
    assert counts(he.ip_frequency(events(spark, rows)), "ip_count") == {"e00031": 31}


def planned(df):
    """The plan before anything has run, while joins are chosen by estimates alone."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_ip_frequency_broadcasts_no_event_rows(spark):
    stored = land(events(spark, [dict(ip="1.2.3.4", offset_us=i) for i in range(32)]))
    hits = he.ip_frequency(stored)
    assert "SortMergeJoin" in planned(hits) and "BuildLeft" not in planned(hits)
    assert counts(hits, "ip_count") == {"e00031": 31}


def test_user_frequency_broadcasts_no_event_rows(spark):
    stored = land(events(spark, [dict(username="u", offset_us=i) for i in range(22)]))
    hits = he.user_frequency(stored)
    assert "SortMergeJoin" in planned(hits) and "BuildLeft" not in planned(hits)
    assert counts(hits, "user_count") == {"e00021": 21}


def test_failed_login_threshold(spark):
    rows = [dict(username="u", eventType="authentication", outcome="failure", offset_us=i * MINUTE) for i in range(6)]
    rows.append(dict(username="u", eventType="authentication", outcome="success", offset_us=6 * MINUTE))
    assert counts(he.failed_logins(events(spark, rows)), "failed_count") == {"e00005": 5}


def test_window_edges(spark):
    # 21 at the start: exactly five minutes later they are out, one microsecond earlier they are in.
    rows = [dict(username="u", offset_us=0) for _ in range(21)]
    rows += [dict(eventId="in", username="u", offset_us=5 * MINUTE - 1), dict(eventId="out", username="u", offset_us=5 * MINUTE)]
    assert counts(he.user_frequency(events(spark, rows)), "user_count") == {"in": 21}


def test_equal_times_do_not_count(spark):
    assert he.user_frequency(events(spark, [dict(username="u") for _ in range(100)])).count() == 0


def brute_frequency(rows, key, window, floor):
    out = {}
    for i, r in enumerate(rows):
        if any(r.get(k) is None for k in key):
            continue
        n = sum(1 for s in rows if all(s.get(k) == r.get(k) for k in key)
                and r["offset_us"] - window < s["offset_us"] < r["offset_us"])
        if n > floor:
            out[f"e{i:05d}"] = n
    return out


def test_frequency_brute_force(spark):
    rng = random.Random(3)
    rows = [dict(username=rng.choice(["hot", "hot", "b", None]), eventName=rng.choice(["Look", "Do"]),
                 offset_us=rng.choice([rng.randrange(20 * MINUTE), rng.randrange(240) * 5_000_000])) for _ in range(500)]
    assert counts(he.user_frequency(events(spark, rows)), "user_count") == brute_frequency(
        rows, ["username", "eventName"], 5 * MINUTE, 20)


def test_trailing_counts_before_1970_and_weights(spark):
    df = spark.createDataFrame([(1, -7, 2), (1, -3, 3), (1, 5, 1), (1, 60, 4)], "k int, t long, n long")
    got = {r["t"]: (r["n"], r["prior"]) for r in trailing_instants(df, ["k"], "t", 60, -1, weight="n").collect()}
    assert got == {-7: (2, 0), -3: (3, 2), 5: (1, 5), 60: (4, 1)}


def brute_first_seen(rows):
    """One event at a time: judge by what came before, then learn."""
    countries, actions, users, out = {}, {}, {}, {"c": set(), "a": set(), "r": set()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["offset_us"], f"e{i:05d}"))
    for i in order:
        r, name = rows[i], f"e{i:05d}"
        user, key = r.get("username"), r.get("username") or r.get("userId")
        country, action, resource = r.get("country"), r["eventName"], r.get("resourceId")
        if r["eventType"] == "authentication" and country and key and countries.get(key) and country not in countries[key]:
            out["c"].add(name)
        if key and len(actions.get(key, ())) > 10 and action not in actions[key]:
            out["a"].add(name)
        if resource and user and len(users.get(resource, ())) > 5 and user not in users[resource]:
            out["r"].add(name)
        if user:
            actions.setdefault(user, set()).add(action)
            if country:
                countries.setdefault(user, set()).add(country)
            if resource:
                users.setdefault(resource, set()).add(user)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = rng.choice(["hot", "hot", "hot", "u1", "u2", "u3", "u4", "u5", "u6", "u7", "u8", None, ""])
        rows.append(dict(
            username=user, userId=rng.choice([None, "hot", "u1"]), eventName=f"Act{rng.randrange(25)}",
            eventType=rng.choice(["authentication", "resource_access"]), country=rng.choice(["US", "CA", "RU", "FR", None, ""]),
            resourceId=rng.choice(["r1", "r2", None]), offset_us=rng.randrange(400) * MINUTE))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_first_seen_brute_force(spark, seed):
    rows = random_rows(seed, 300)
    expected = brute_first_seen(rows)
    df = events(spark, rows)
    assert ids(he.new_locations(df)) == sorted(expected["c"])
    assert ids(he.unusual_actions(df)) == sorted(expected["a"])
    assert ids(he.unusual_accessors(df)) == sorted(expected["r"])


def test_baseline_carries_on(spark):
    """Scoring the second half against the first half's pairs equals scoring everything at once."""
    from pyspark.sql import functions as F
    rows = random_rows(5, 300)
    df = events(spark, rows)
    cut = df.agg(F.expr("min(timestamp) + interval 200 minutes").alias("c")).first()["c"]
    past, fresh = df.where(F.col("timestamp") < F.lit(cut)), df.where(F.col("timestamp") >= F.lit(cut))
    late = {r["eventId"] for r in fresh.collect()}
    expected = brute_first_seen(rows)
    assert ids(he.unusual_actions(fresh, he.action_pairs(past), F.lit(cut))) == sorted(expected["a"] & late)
    assert ids(he.new_locations(fresh, he.country_pairs(past), F.lit(cut))) == sorted(expected["c"] & late)
    assert ids(he.unusual_accessors(fresh, he.accessor_pairs(past), F.lit(cut))) == sorted(expected["r"] & late)


def test_known_counts_at_the_threshold(spark):
    actions = [dict(username="u", eventName=f"A{i:02d}", offset_us=i) for i in range(12)]
    assert ids(he.unusual_actions(events(spark, actions))) == ["e00011"]  # eleven known, not ten
    accessors = [dict(username=f"u{i}", resourceId="r", offset_us=i) for i in range(8)]
    assert ids(he.unusual_accessors(events(spark, accessors))) == ["e00006", "e00007"]  # six known, not five


def test_rank_filter_is_pruned_before_the_shuffle(spark):
    pairs = first_pairs(events(spark, [dict(username="u")]).select("timestamp", "eventId", "eventName", "outcome"),
                        "eventName", "outcome", [])
    plan = kth_first(pairs, "eventName", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("hour,minute,expected,score", [
    (21, 59, [], 0.0), (22, 0, ["Activity during unusual hours (22:00)"], 0.4), (5, 59, ["Activity during unusual hours (05:00)"], 0.4),
    (6, 0, [], 0.0), (1, 59, ["Activity during unusual hours (01:00)"], 0.4),
    (2, 0, ["Activity during unusual hours (02:00)", "Activity during very early morning hours"], 0.6),
    (4, 59, ["Activity during unusual hours (04:00)", "Activity during very early morning hours"], 0.6),
    (5, 0, ["Activity during unusual hours (05:00)"], 0.4),
])
def test_unusual_time(spark, hour, minute, expected, score):
    from datetime import datetime
    row = he.with_heuristics(events(spark, [dict()], datetime(2024, 11, 13, hour, minute))).first()["heuristic"]
    assert (row["indicators"], row["score"], row["isSuspicious"]) == (expected, score, bool(expected))


def test_sensitive_and_critical(spark):
    rows = [dict(eventName="DeleteKey", resourceId="r", criticality="critical"), dict(eventName="Look", resourceId="r", criticality="low")]
    got = [r["heuristic"]["indicators"] for r in he.with_heuristics(events(spark, rows)).orderBy("eventId").collect()]
    assert got == [["Sensitive operation detected: key", "Access to high-criticality resource"], []]


def test_signals_reach_their_events(spark):
    rows = [dict(username="u", ip="1.1.1.1", offset_us=i) for i in range(60)]
    df = events(spark, rows)
    judged = he.with_heuristics(df, he.history_signals(df))
    last = judged.where("eventId = 'e00059'").first()["heuristic"]
    assert last["indicators"] == ["High frequency of Look by u", "High frequency from IP 1.1.1.1"]
    assert last["score"] == 1.0 and judged.count() == 60
    assert judged.where("heuristic.isSuspicious").count() == 39


def test_events_of_one_id_keep_their_own_signals(spark):
    """Two events share provider, id and time; only the one from the busy address is frequent."""
    busy = [dict(eventId=f"b{i}", ip="9.9.9.9", offset_us=i) for i in range(he.IP_FLOOR + 30)]
    last = he.IP_FLOOR + 40
    df = events(spark, [*busy, dict(eventId="same", ip="9.9.9.9", offset_us=last), dict(eventId="same", ip="8.8.8.8", offset_us=last)])
    got = he.with_heuristics(df, he.history_signals(df)).where("eventId = 'same'").select("actor.ipAddress", "heuristic.indicators").collect()
    assert len(got) == 2
    said = {r.ipAddress: any("IP" in i for i in r.indicators) for r in got}
    assert said == {"9.9.9.9": True, "8.8.8.8": False}
