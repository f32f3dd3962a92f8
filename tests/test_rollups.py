"""Merged daily roll-ups against plain counts."""

from collections import defaultdict

from helpers import MINUTE, events
from pyspark.sql import functions as F

from palisade.operators import rollups as ro

DAY = 24 * 60 * MINUTE


def sample():
    rows = []
    for i in range(6000):
        user = "hot" if i % 3 else f"u{i % 11}"
        rows.append(dict(username=user, eventName=f"Act{i % 700}", country=["US", "DE", None][i % 3 if i % 2 else 2], resourceId=f"r{i % 4}" if i % 5 else None,
                         offset_us=(i % 4) * DAY + (i * i % 600) * MINUTE))
    return rows + [dict(username=None, resourceId="r0"), dict(username="", resourceId="r0"), dict(username="quiet", resourceId="")]


def test_merged_days(spark, scratch):
    rows = sample()
    df = events(spark, rows)
    for part in (df, df.where(F.to_date("timestamp") == "2024-11-14")):  # a day delivered again replaces itself
        ro.write_days(ro.user_days(part), f"{scratch}/users")
        ro.write_days(ro.resource_days(part), f"{scratch}/resources")
    want = defaultdict(lambda: [0, set(), set()])
    for r in rows:
        if r["username"]:
            one = want[r["username"]]
            one[0] += 1
            one[1].add(r.get("eventName", "Look"))
            one[2] |= {r["country"]} if r.get("country") else set()
    got = {r.user: r for r in ro.merged_users(ro.read_days(spark, f"{scratch}/users")).collect()}
    assert got.keys() == want.keys()
    for user, (n, actions, countries) in want.items():
        r = got[user]
        assert r.n_events == n == sum(r.hours) and r.n_countries == len(countries)
        assert abs(r.n_actions - len(actions)) <= max(1, 0.05 * len(actions))
        assert 1 <= r.hour_quantiles[0] <= r.hour_quantiles[1]
    resources = {r.resourceId: (r.access_count, r.n_users) for r in ro.merged_resources(ro.read_days(spark, f"{scratch}/resources")).collect()}
    users = defaultdict(list)
    for r in rows:
        if r.get("resourceId"):
            users[r["resourceId"]].append(r["username"])
    assert resources == {k: (len(v), len({u for u in v if u})) for k, v in users.items()}


def test_a_range_reads_its_days_only(spark, scratch):
    df = events(spark, [dict(username="a", offset_us=d * DAY) for d in range(5)] + [dict(username="a", offset_us=2 * DAY)])
    ro.write_days(ro.user_days(df), f"{scratch}/users")
    days = ro.read_days(spark, f"{scratch}/users", "2024-11-14", "2024-11-16")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0] and ro.merged_users(days).first().n_events == 3
    nothing = events(spark, [dict(username="a")]).where("false")
    assert ro.merged_users(ro.user_days(nothing)).count() == 0 and ro.merged_resources(ro.resource_days(nothing)).count() == 0
