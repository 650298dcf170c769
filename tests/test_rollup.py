import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, event, events_df, ms
from joined_form import hourly_rollup_joined
from playerlytics.functions import time as T
from playerlytics.operators import clean, rollup
from playerlytics.sources.events import behavior_source, player_info_source
from playerlytics.sources.fixtures import load_game_events
from playerlytics.sources.schemas import MEASURES

JAN = T.MonthRange.one("202401")
H10 = ms("2024-01-05 10:00:00")


def _hourly(spark, rows, driver="levels"):
    ev = events_df(spark, rows)
    return rollup.hourly_rollup(player_info_source(ev), behavior_source(ev, JAN), driver)


def _by_user(df):
    return {(r.userId, r.hourOfDay): r for r in df.collect()}


def test_trim_and_family_counts(spark):
    rows = [
        event(user=" u1 ", game=" GAME_A", ts=H10, levelId=" L1", status=" COMPLETED ", levelDifficulty=" easy "),
        event(user="u1", ts=H10, levelId="L2", status="STARTED"),
        event(user="u1", ts=H10, adType="rewarded", status="WATCHED", placementId=" top "),
        event(user="u1", ts=H10, amount=2.5, status="DONE", itemId="I1"),
        # one event that is a level and a purchase: counted in both families
        event(user="u1", ts=H10, levelId="L3", amount=1.0, status="DONE"),
        # lower-case and unknown statuses are rows but no counter moves
        event(user="u1", ts=H10, levelId="L4", status="completed"),
        event(user="u1", ts=H10, levelId="L5", status="FAILED"),
    ]
    r = _by_user(_hourly(spark, rows))[("u1", 10)]
    assert r.gameId == "GAME_A"
    assert (r.numLevelsCompleted, r.numLevelsStarted, r.numAdsWatched, r.numPurchasesDone) == (1, 1, 1, 2)
    assert r.amountPurchasesDoneDol == pytest.approx(3.5)
    assert r.partOfDay == "morning" and r.dayOfWeek == 6 and r.date == dt.date(2024, 1, 5)
    lv = clean.clean_levels(behavior_source(events_df(spark, rows), JAN)).collect()
    assert {x.levelDifficulty for x in lv} == {" easy ", None}       # not trimmed
    ads = clean.clean_ads(behavior_source(events_df(spark, rows), JAN)).first()
    assert ads.placementId == " top "


def test_level_driven_hours(spark):
    rows = [
        event(user="u1", ts=H10, levelId="L1", status="COMPLETED"),
        event(user="u1", ts=ms("2024-01-05 14:00:00"), adType="banner", status="WATCHED"),  # ads only
    ]
    assert set(_by_user(_hourly(spark, rows))) == {("u1", 10)}
    anyd = _by_user(_hourly(spark, rows, driver="any"))
    assert set(anyd) == {("u1", 10), ("u1", 14)} and anyd[("u1", 14)].numAdsWatched == 1


def test_null_user_rows_get_zero_ads(spark):
    rows = [
        event(user=None, ts=H10, levelId="L1", status="COMPLETED"),
        event(user=None, ts=H10, adType="banner", status="WATCHED"),
        event(user="u2", ts=H10, levelId="L1", status="COMPLETED"),
        event(user="u2", ts=H10, adType="banner", status="WATCHED"),
        event(user="u1", game=None, ts=H10, levelId="L1", status="COMPLETED"),
        event(user="u1", game=None, ts=H10, adType="banner", status="WATCHED"),
    ]
    got = {(r.userId, r.gameId): r.numAdsWatched for r in _hourly(spark, rows).collect()}
    assert got == {(None, "GAME_A"): 0, ("u2", "GAME_A"): 1, ("u1", None): 0}


def test_registration(spark):
    d1, d2 = ms("2024-01-02 08:00:00"), ms("2023-12-20 08:00:00")
    rows = [
        event(user="u1", ts=d1, attribution="paid_ads", action="SIGN_UP"),
        event(user="u1", ts=d2, attribution="organic", action="SIGN_UP"),     # earlier, before the range
        event(user="u2", ts=d1, attribution="organic", action="LOGIN"),       # never signs up
        event(user="u1", ts=H10, levelId="L1", status="COMPLETED"),
        event(user="u2", ts=H10, levelId="L1", status="COMPLETED"),
    ]
    got = {r.userId: (r.flagOrganic, r.dateRegistration) for r in _hourly(spark, rows).collect()}
    assert got == {"u1": (1, dt.date(2023, 12, 20)), "u2": (0, None)}


def _adapter(spark):
    ev = load_game_events(spark, SF_SMALL)
    months = T.MonthRange("202401", "202403")
    return player_info_source(ev), behavior_source(ev, months)


def test_single_pass_equals_join_form(spark):
    info, beh = _adapter(spark)
    a = rollup.hourly_rollup(info, beh)
    b = hourly_rollup_joined(info, beh)
    assert a.count() == 307                       # FIXTURES.md, sf0.001
    cols = a.columns
    rnd = [F.round(c, 9).alias(c) if c.startswith("amount") else F.col(c) for c in cols]
    assert a.select(*rnd).exceptAll(b.select(*rnd)).count() == 0
    assert b.select(*rnd).exceptAll(a.select(*rnd)).count() == 0


def test_hour_day_month_sums_agree(spark):
    info, beh = _adapter(spark)
    h = rollup.hourly_rollup(info, beh)
    d = rollup.daily_rollup(h)
    m = rollup.monthly_rollup(d)
    tot = lambda df: [round(v, 6) for v in df.agg(*[F.sum(c) for c in MEASURES]).first()]
    assert tot(h) == tot(d) == tot(m)
    assert d.select("userId", "gameId", "date", "partOfDay").distinct().count() == d.count()


def test_plan_single_behaviour_aggregation(spark):
    info, beh = _adapter(spark)
    plan = rollup.hourly_rollup(info, beh)._jdf.queryExecution().optimizedPlan().toString()
    # one aggregate for the behaviour rows (partial/final is one logical node) + one for registration
    assert plan.count("Aggregate [") == 2


def test_preview_latest(spark):
    info, beh = _adapter(spark)
    d = rollup.daily_rollup(rollup.hourly_rollup(info, beh))
    p = rollup.preview_latest(d, 15).collect()
    assert len(p) == 15
    assert p[0].date == d.agg(F.max("date")).first()[0]
    assert [r.date for r in p] == sorted([r.date for r in p], reverse=True)


def test_one_scan_cleaning_matches_family_cleaning(spark):
    ev = load_game_events(spark, SF_SMALL)
    months = T.MonthRange("202401", "202403")
    cleaned = clean.clean_events(ev, months)
    info, beh = player_info_source(ev), behavior_source(ev, months)
    pairs = {"player": clean.clean_players(info), "level": clean.clean_levels(beh),
             "ad": clean.clean_ads(beh), "purchase": clean.clean_purchases(beh)}
    for fam, want in pairs.items():
        got = clean.family_rows(cleaned, fam)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, fam
    a = rollup.hourly_rollup_from_clean(cleaned, months)
    b = rollup.hourly_rollup(info, beh)
    rnd = [F.round(c, 9).alias(c) if c.startswith("amount") else F.col(c) for c in a.columns]
    assert a.select(*rnd).exceptAll(b.select(*rnd)).count() == 0
    assert b.select(*rnd).exceptAll(a.select(*rnd)).count() == 0
    # the source is scanned once
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Generate inline" in plan


def test_irrelevant_columns_and_json_source(spark, tmp_path):
    from playerlytics.sources.events import read_events
    ev = load_game_events(spark, SF_SMALL)
    noisy = ev.withColumn("deviceModel", F.lit("x")).withColumn("sessionLength", F.lit(3.5))
    path = str(tmp_path / "raw-json")
    noisy.drop("currency").write.json(path)          # one declared field missing entirely
    back = read_events(spark, path, fmt="json")
    months = T.MonthRange("202401", "202403")
    a = rollup.hourly_rollup(player_info_source(back), behavior_source(back, months))
    b = rollup.hourly_rollup(player_info_source(ev), behavior_source(ev, months))
    from playerlytics.sources.schemas import EVENT_SCHEMA
    assert back.columns == EVENT_SCHEMA.fieldNames()
    assert back.where(F.col("currency").isNotNull()).count() == 0
    rnd = [F.round(c, 9).alias(c) if c.startswith("amount") else F.col(c) for c in a.columns]
    assert a.select(*rnd).exceptAll(b.select(*rnd)).count() == 0 and a.count() == b.count() == 307
