import datetime as dt

import pytest

from playerlytics.operators import ltv

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def _rows(spark):
    return spark.createDataFrame([
        ("u1", "G", 0, D1, "morning", 2, 10),
        ("u1", "G", 0, D1, "evening", 0, 4),
        ("u2", "G", 1, D1, "morning", 0, 2),
        ("u3", "G", 1, D2, "night", 0, 6),   # nobody completes a level on D2
    ], "userId string, gameId string, cluster int, date date, partOfDay string, "
       "numLevelsCompleted long, numAdsWatched long")


def test_user_daily_flag_and_users(spark):
    rows = _rows(spark)
    flag = {(r.userId, r.date): r.ltv for r in ltv.ltv_user_daily(rows).collect()}
    # Active by flag = distinct {true, false} = 2; u1 lifetime 2, revenue 14 * 0.015
    assert flag[("u1", D1)] == pytest.approx(14 * 0.015 / 2 * 2)
    assert flag[("u3", D2)] == pytest.approx(6 * 0.015 / 1 * 1)
    users = {(r.userId, r.date): r.ltv for r in ltv.ltv_user_daily(rows, active="users").collect()}
    assert users[("u1", D1)] == pytest.approx(14 * 0.015 / 1 * 2)
    assert users[("u3", D2)] is None          # 0 active players: null, not an error


def test_by_cluster_and_points(spark):
    rows = _rows(spark)
    by_c = {r.cluster: r.ltv for r in ltv.ltv_by_cluster(rows).collect()}
    assert by_c == pytest.approx({0: 14 * 0.015, 1: 8 * 0.015 / 2})
    pts = {(r.cluster, r.date): (r.sumLtv, r.avgLtv) for r in ltv.ltv_points_daily_by_cluster(rows).collect()}
    # cluster 1 on D1: only u2, active flag within the cluster = 1
    assert pts[(1, D1)] == pytest.approx((2 * 0.015, 2 * 0.015))


def test_monthly(spark):
    rows = _rows(spark)
    m = {r.userId: r.ltv for r in ltv.ltv_user_monthly(rows).collect()}
    # month active flag: {true, false} = 2; u1 lifetime = 1 distinct date
    assert m["u1"] == pytest.approx(14 * 0.015 / 2 * 1)
    assert ltv.ltv_points_monthly(rows).first().codMonth == "202401"


@pytest.mark.parametrize("active", ["flag", "users"])
def test_series_hold_no_join_and_equal_the_sums_per_player(spark, active):
    rows = _rows(spark).unionByName(spark.createDataFrame(
        [(None, "G", 0, D1, "night", 3, 5), ("u4", "G", 0, D1, "night", None, None)], _rows(spark).schema))
    for series, per_user, period, by in (
            (ltv.ltv_points_daily(rows, active), ltv.ltv_user_daily(rows, active=active), "date", ()),
            (ltv.ltv_points_daily_by_cluster(rows, active), ltv.ltv_user_daily(rows, ("cluster",), active), "date", ("cluster",)),
            (ltv.ltv_points_monthly(rows, active), ltv.ltv_user_monthly(rows, active), "codMonth", ())):
        want = ltv.ltv_points(per_user, period, by).collect()
        got = series.collect()
        assert [r[:-2] for r in got] == [r[:-2] for r in want]
        assert [r[-2:] for r in got] == [pytest.approx(r[-2:]) if None not in r[-2:] else r[-2:] for r in want]
        assert "Join" not in series._jdf.queryExecution().executedPlan().toString()


def test_a_hot_date_is_reduced_before_its_shuffle(spark):
    """98% of the players on one date: no task of the series receives them by date alone."""
    rows = spark.range(0, 20_000).selectExpr(
        "concat('u', id) AS userId", "'G' AS gameId", "0 AS cluster",
        "IF(id % 50 = 0, DATE'2024-01-02', DATE'2024-01-01') AS date", "'night' AS partOfDay",
        "id % 3 AS numLevelsCompleted", "id % 5 AS numAdsWatched")
    plan = ltv.ltv_points_daily(rows)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "userId" in shuffles[1] and "Join" not in plan
    below = plan.splitlines()[[i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line][0] + 1]
    assert "HashAggregate" in below and "partial_" in below   # a row per date and task crosses it
