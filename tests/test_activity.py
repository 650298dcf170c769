"""Retention from the stored activity table against the joined form; bitmaps against plain distinct counts."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, event, events_df, ms
from playerlytics.operators import activity, clean, distinct, retention, rollup
from playerlytics.sources.events import behavior_source, player_info_source
from playerlytics.sources.fixtures import load_game_events


def inputs(spark, events):
    info = player_info_source(events)
    return clean.clean_players(info), rollup.hourly_rollup(info, behavior_source(events, None))


def points(df):
    return sorted(map(str, df.toLocalIterator()))


@pytest.mark.parametrize("idle,cohort,full", [(0, "any", False), (3, "any", False), (40, "any", True), (2, "signup", True), (95, "any", False)])
def test_points_equal_the_joined_form(spark, idle, cohort, full):
    players, hourly = inputs(spark, load_game_events(spark, SF_SMALL))
    table = activity.masks(players, hourly).cache()
    want = points(retention.retention_points(players, hourly, "202401", idle, cohort, full))
    assert points(activity.retention_points(table, "202401", idle, cohort, full)) == want and want


@pytest.mark.parametrize("month", ["202402", "202412", "202404"])
def test_random_players_null_games_and_month_ends(spark, month):
    rng = random.Random(month)
    year, m = int(month[:4]), int(month[4:])
    rows = []
    for i in range(150):
        mm = m + rng.randint(0, 2)
        when = f"{year + (mm - 1) // 12}-{(mm - 1) % 12 + 1:02d}-{rng.choice([1, 2, 27, 28])} 12:00:00"
        when = when.replace("-1 ", "-01 ").replace("-2 ", "-02 ")
        kind = rng.choice([{"levelId": "L", "status": "STARTED"}, {"levelId": "L", "status": "OTHER"}, {"attribution": "organic", "action": "SIGN_UP"},
                           {"attribution": "organic", "action": "LOGIN"}])
        rows.append(event(user=rng.choice(["u1", "u2", "u3", None]), game=rng.choice(["A", None]), ts=ms(when), **kind))
    players, hourly = inputs(spark, events_df(spark, rows))
    table = activity.masks(players, hourly)
    for idle, cohort, full in ((0, "any", True), (5, "signup", False)):
        assert points(activity.retention_points(table, month, idle, cohort, full)) == \
            points(retention.retention_points(players, hourly, month, idle, cohort, full))


def test_runs_merge_and_one_scan_suffices(spark, tmp_path):
    players, hourly = inputs(spark, load_game_events(spark, SF_SMALL))
    whole = activity.masks(players, hourly)
    halves = [activity.masks(players.where(p), hourly.where(p)) for p in (F.dayofmonth("date") % 2 == 0, F.dayofmonth("date") % 2 == 1)]
    assert activity.merged(halves[0].unionByName(halves[1])).exceptAll(whole).count() == 0
    path = str(tmp_path / "masks")
    whole.write.partitionBy("codMonth").parquet(path)
    table = spark.read.schema(activity.MASK_SCHEMA).parquet(path)
    plan = activity.retention_points(table, "202401", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "PartitionFilters: [isnotnull(codMonth" in plan


def test_empty_table(spark):
    assert activity.retention_points(spark.createDataFrame([], activity.MASK_SCHEMA), "202401").count() == 0


def test_numbers_stay_and_bitmaps_merge(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["A", "B", None]), rng.randint(0, 3), None if rng.random() < 0.05 else f"u{rng.randint(0, 5000)}") for _ in range(20_000)]
    rows += [("C", 0, None)]
    df = spark.createDataFrame(rows, "gameId string, day int, userId string").cache()
    none = spark.createDataFrame([], distinct.NUMBER_SCHEMA)
    first = distinct.new_numbers(none, df.where("day < 2")).cache()
    more = distinct.new_numbers(first, df).cache()
    numbers = first.unionByName(more)
    assert more.count() > 0 and distinct.new_numbers(numbers, df).count() == 0
    assert numbers.select("number").distinct().count() == numbers.count() == df.where("userId IS NOT NULL").select("userId").distinct().count()
    parts = distinct.bitmaps(df, numbers, ["gameId", "day"]).cache()
    for keys in (["gameId"], ["gameId", "day"], ["day"], []):
        want = df.groupBy(*keys).agg(F.count_distinct("userId").alias("players"))
        got = distinct.distinct_players(parts, keys)
        assert sorted(map(str, got.toLocalIterator())) == sorted(map(str, want.toLocalIterator()))
