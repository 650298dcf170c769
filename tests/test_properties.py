"""Randomised properties (hypothesis): single pass = per-family joins; retention = brute force."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import event, events_df, ms
from joined_form import hourly_rollup_joined
from test_retention import brute_force
from playerlytics.functions import time as T
from playerlytics.operators import retention, rollup
from playerlytics.sources.events import behavior_source, player_info_source

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
BASE = ms("2024-01-30 00:00:00")

users = st.sampled_from(["u1", " u1 ", "u2", None])
games = st.sampled_from(["G", " G", None])
zones = st.sampled_from([None, "+02.00", "-05:00", "+05:30", "Europe/Warsaw"])
statuses = st.sampled_from(["COMPLETED", "STARTED", "WATCHED", "IGNORED", "PROPOSED", "DONE", "REJECTED",
                            "CANCELED", "completed", " DONE ", None])


@st.composite
def game_event(draw):
    kw = {}
    if draw(st.booleans()):
        kw["levelId"] = "L1"
    if draw(st.booleans()):
        kw["adType"] = "banner"
    if draw(st.booleans()):
        kw["amount"] = draw(st.sampled_from([0.5, 1.25, 3.0]))
    if draw(st.integers(0, 4)) == 0:
        kw["attribution"] = draw(st.sampled_from(["organic", "paid_ads"]))
        kw["action"] = draw(st.sampled_from(["SIGN_UP", "LOGIN"]))
    return event(user=draw(users), game=draw(games), ts=BASE + draw(st.integers(0, 4 * 24)) * 3_600_000,
                 tz=draw(zones), status=draw(statuses), **kw)


@SETTINGS
@given(st.lists(game_event(), min_size=1, max_size=25))
def test_single_pass_equals_family_joins(spark, rows):
    ev = events_df(spark, rows)
    info, beh = player_info_source(ev), behavior_source(ev, T.MonthRange("202401", "202402"))
    a = rollup.hourly_rollup(info, beh)
    b = hourly_rollup_joined(info, beh)
    rnd = [F.round(c, 9).alias(c) if c.startswith("amount") else F.col(c) for c in a.columns]
    assert a.select(*rnd).exceptAll(b.select(*rnd)).count() == 0
    assert b.select(*rnd).exceptAll(a.select(*rnd)).count() == 0


day = st.integers(0, 70).map(lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["G", "H"]),
                          st.sampled_from(["SIGN_UP", "LOGIN"]), day), min_size=1, max_size=12),
       st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["G", "H"]), day,
                          st.integers(0, 2), st.integers(0, 1)), max_size=25),
       st.integers(0, 4), st.booleans(), st.sampled_from(["any", "signup"]))
def test_retention_matches_brute_force(spark, players, activity, idle, full, cohort):
    pl = spark.createDataFrame(players, "userId string, gameId string, action string, date date")
    dl = spark.createDataFrame(activity, "userId string, gameId string, date date, "
                                         "numLevelsCompleted long, numLevelsStarted long")
    got = {(r.gameId, r.pivotDate, r.dayRetention): (r.newUsers, r.activeUsers)
           for r in retention.retention_points(pl, dl, "202401", idle, cohort, full).collect()}
    want = brute_force([dict(zip(("userId", "gameId", "action", "date"), p)) for p in players],
                       [dict(zip(("userId", "gameId", "date", "numLevelsCompleted", "numLevelsStarted"), a))
                        for a in activity], "202401", idle, full, cohort)
    assert got == {k: v[:2] for k, v in want.items()}
