import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from playerlytics.functions import time as T
from playerlytics.operators import clean, retention, rollup
from playerlytics.sources.events import behavior_source, player_info_source
from playerlytics.sources.fixtures import load_game_events


def brute_force(players, daily, start_month, idle, full_horizon=False, cohort="any"):
    """The definition, as nested loops: pivot x offset x member x window day."""
    n = T.days_in_month(start_month)
    month = T.MonthRange.one(start_month)
    lo, hi = retention.activity_range(start_month, idle, full_horizon)
    act = defaultdict(lambda: [0, 0])
    for r in daily:
        if lo <= r["date"] <= hi:
            a = act[(r["gameId"], r["userId"], r["date"])]
            a[0] += r["numLevelsCompleted"]
            a[1] += r["numLevelsStarted"]
    cohorts = defaultdict(set)
    seen = set()
    for p in players:
        if month.first_day <= p["date"] <= month.last_day and (cohort == "any" or p["action"] == "SIGN_UP"):
            seen.add((p["gameId"], p["date"]))
            if p["userId"] is not None:
                cohorts[(p["gameId"], p["date"])].add(p["userId"])
    out = {}
    for (g, pivot) in seen:
        members = cohorts[(g, pivot)]
        if not members:
            continue
        for i in range(1, n + 1):
            active = 0
            for u in members:
                c = s = 0
                for k in range(i, i + idle + 1):
                    a = act.get((g, u, pivot + dt.timedelta(days=k)))
                    if a:
                        c += a[0]
                        s += a[1]
                active += (c > 0 or s > 0)
            out[(g, pivot, i)] = (len(members), active, active / len(members) * 100.0)
    return out


@pytest.fixture(scope="module")
def inputs(spark):
    ev = load_game_events(spark, SF_SMALL)
    players = clean.clean_players(player_info_source(ev))
    daily = rollup.daily_rollup(rollup.hourly_rollup(player_info_source(ev),
                                                     behavior_source(ev, T.MonthRange("202401", "202403"))))
    return players, daily, [r.asDict() for r in players.collect()], [r.asDict() for r in daily.collect()]


@pytest.mark.parametrize("idle,full,cohort", [(0, False, "any"), (3, False, "any"), (3, True, "any"),
                                              (0, False, "signup"), (40, False, "any")])
def test_matches_brute_force(spark, inputs, idle, full, cohort):
    players, daily, prow, drow = inputs
    got = {(r.gameId, r.pivotDate, r.dayRetention): (r.newUsers, r.activeUsers, r.retentionRate)
           for r in retention.retention_points(players, daily, "202401", idle, cohort, full).collect()}
    want = brute_force(prow, drow, "202401", idle, full, cohort)
    assert set(got) == set(want) and len(got) > 0
    for k, v in want.items():
        assert got[k][:2] == v[:2], k
        assert got[k][2] == pytest.approx(v[2])


def test_non_decreasing_in_idle(inputs):
    players, daily, _, _ = inputs
    p0 = retention.retention_points(players, daily, "202401", 0).withColumnRenamed("retentionRate", "r0")
    p3 = retention.retention_points(players, daily, "202401", 3).withColumnRenamed("retentionRate", "r3")
    j = p0.join(p3, ["gameId", "pivotDate", "dayRetention"])
    assert j.count() == p0.count() and j.where(F.col("r3") < F.col("r0")).count() == 0


def test_hand_made_cases(spark):
    pl = spark.createDataFrame([
        ("u1", "G", "SIGN_UP", dt.date(2024, 1, 30)),
        ("u1", "G", "LOGIN", dt.date(2024, 1, 31)),     # same player, second cohort
        ("u2", "G", "SIGN_UP", dt.date(2024, 1, 31)),   # no later activity
        (None, "G", "SIGN_UP", dt.date(2024, 1, 15)),   # only a null id: cohort of size 0, dropped
    ], "userId string, gameId string, action string, date date")
    dl = spark.createDataFrame([
        ("u1", "G", dt.date(2024, 1, 30), 1, 0),   # on the pivot day itself: not counted
        ("u1", "G", dt.date(2024, 2, 2), 0, 1),    # across the month end
    ], "userId string, gameId string, date date, numLevelsCompleted long, numLevelsStarted long")
    pts = {(r.pivotDate.day, r.dayRetention): (r.newUsers, r.activeUsers)
           for r in retention.retention_points(pl, dl, "202401", 1).collect()}
    assert {p for p, _ in pts} == {30, 31}
    assert pts[(30, 3)] == (1, 1) and pts[(30, 2)] == (1, 1) and pts[(30, 1)] == (1, 0)
    assert pts[(31, 1)] == (2, 1) and pts[(31, 2)] == (2, 1) and pts[(31, 3)] == (2, 0)
    avg = {r.dayRetention: r.avgRetentionRate
           for r in retention.monthly_average(retention.retention_points(pl, dl, "202401", 1), "202401").collect()}
    assert avg[2] == pytest.approx((100.0 + 50.0) / 31)


def test_activity_range():
    assert retention.activity_range("202401", 0) == (dt.date(2024, 1, 1), dt.date(2024, 2, 29))
    assert retention.activity_range("202401", 0, True) == (dt.date(2024, 1, 1), dt.date(2024, 3, 2))
    assert retention.activity_range("202402", 31) == (dt.date(2024, 2, 1), dt.date(2024, 4, 30))


def test_masks_of_any_horizon_count_the_hit_offsets(spark, inputs):
    players, daily, _, _ = inputs
    n = 31
    for idle in (0, 3, 31, 62, 95):   # one, two and three words
        lo, hi = retention.activity_range("202401", idle, True)
        act = retention.daily_activity(daily.where(F.col("date").between(F.lit(lo), F.lit(hi))))
        hits = retention.cohort_activity(retention.cohort_members(
            retention.cohort_events(players, "202401", "any")), act, n, idle)
        want = {}
        for r in hits.collect():
            for i in range(max(1, r.daysAfterPivot - idle), min(n, r.daysAfterPivot) + 1):
                want.setdefault((r.gameId, r.pivotDate, i), set()).add(r.userId)
        got = {(r.gameId, r.pivotDate, r.dayRetention): r.activeUsers
               for r in retention.active_by_mask(hits, n, idle).where("activeUsers > 0").collect()}
        assert got == {k: len(v) for k, v in want.items()} and got
