import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, event, events_df, ms
from playerlytics.functions import time as T
from playerlytics.plans import jobs
from playerlytics.sources import tables
from playerlytics.sources.fixtures import load_game_events
from playerlytics.sources.schemas import DAILY_TABLE, HOURLY_TABLE, MONTHLY_TABLE, RAW_TABLE, TABLE_SCHEMAS


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("enrich"))
    ev = load_game_events(spark, SF_SMALL)
    res = jobs.run_enrich(spark, ev, out, T.MonthRange("202401", "202403"), "both")
    return out, res


def test_enrich_writes_all_tables(spark, enriched):
    out, res = enriched
    assert set(res.tables) == {HOURLY_TABLE, DAILY_TABLE, MONTHLY_TABLE, RAW_TABLE}
    fams = {r.family: r[1] for r in tables.read_table(spark, res.tables[RAW_TABLE], TABLE_SCHEMAS[RAW_TABLE]).groupBy("family").count().collect()}
    assert set(fams) == {"playerEvent", "levelEvent", "adEvent", "purchaseEvent"}
    assert res.counts[HOURLY_TABLE] == 307
    d = tables.read_rollup(spark, out, "daily")
    m = tables.read_rollup(spark, out, "monthly")
    assert d.count() == res.counts[DAILY_TABLE] and m.count() == res.counts[MONTHLY_TABLE]
    assert dict(m.dtypes)["codMonth"] == "int"
    assert res.previews[MONTHLY_TABLE].count() == 15


def test_partition_filters_reach_the_scan(spark, enriched):
    out, _ = enriched
    df = tables.segmentation_input(tables.read_rollup(spark, out, "daily"), "daily", "GAME_A",
                                   T.MonthRange("202402", "202402"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(gameId), EqualTo(gameId,GAME_A)]" in plan


def test_dynamic_rerun_keeps_other_months(spark, enriched, tmp_path):
    out = str(tmp_path / "rerun")
    ev = load_game_events(spark, SF_SMALL)
    jobs.run_enrich(spark, ev, out, T.MonthRange("202401", "202403"), "daily", write_raw=False)
    before = tables.read_rollup(spark, out, "daily")
    n_feb = before.where(F.month("date") == 2).count()
    # re-run January only, from January's events only: February stays as it was
    jan_only = ev.where(F.col("timestamp") < T.MonthRange.one("202401").epoch_ms_bounds()[1])
    jobs.run_enrich(spark, jan_only, out, T.MonthRange.one("202401"), "daily", write_raw=False)
    after = tables.read_rollup(spark, out, "daily")
    assert after.where(F.month("date") == 2).count() == n_feb > 0


def test_analysis_jobs(spark, enriched, tmp_path):
    out, _ = enriched
    months = T.MonthRange("202401", "202403")
    costs = jobs.run_elbow(spark, out, "GAME_A", months, 2, 3)
    assert costs.count() == 2
    seg = jobs.run_segmentation(spark, out, "GAME_A", months, 3, str(tmp_path / "model"), str(tmp_path / "clusters"))
    assert seg.centers.count() == 3
    assert seg.profiles["users"].count() <= 3
    ltv_c = jobs.run_ltv(spark, seg.clusters_path, "GAME_A", months, "cluster")["ltv_by_cluster"]
    assert ltv_c.count() == seg.profiles["users"].count()
    ltv_m = jobs.run_ltv(spark, seg.clusters_path, "GAME_A", months, "user", "monthly",
                         monthly_out=str(tmp_path / "ltv_monthly"))
    assert ltv_m["ltv_points_monthly"].count() == 3
    ltv_d = jobs.run_ltv(spark, seg.clusters_path, "GAME_A", months, "user", "daily")
    assert ltv_d["ltv_points_daily_by_cluster"].count() >= ltv_d["ltv_points_daily"].count()
    ret = jobs.run_retention(spark, out, "GAME_A", "202401", 3)
    pts = ret["points"]
    assert pts.count() == 31 * pts.select("pivotDate").distinct().count() > 0
    assert ret["monthly_avg"].count() == 31


def test_monthly_cluster_table_refused_by_ltv(spark, enriched, tmp_path):
    out, _ = enriched
    seg = jobs.run_segmentation(spark, out, "GAME_A", T.MonthRange("202401", "202403"), 2,
                                str(tmp_path / "m"), str(tmp_path / "c"), granularity="monthly")
    with pytest.raises(ValueError):
        jobs.run_ltv(spark, seg.clusters_path, "GAME_A", T.MonthRange("202401", "202403"), "cluster")


def test_partitioned_writes_make_few_files(spark, enriched):
    import pathlib
    out, res = enriched
    from collections import Counter
    for table in (HOURLY_TABLE, DAILY_TABLE):
        per_dir = Counter(f.parent for f in pathlib.Path(res.tables[table]).rglob("*.parquet"))
        assert per_dir and max(per_dir.values()) <= 2, (table, max(per_dir.values()))


def _level(user, when, tz="+00:00"):
    return event(user=user, ts=ms(when), tz=tz, levelId="L1", status="COMPLETED")


def _ad(user, when):
    return event(user=user, ts=ms(when), adType="banner", status="WATCHED")


@pytest.mark.parametrize("write_raw", [True, False])
@pytest.mark.parametrize("overwrite", ["period", "dynamic"])
def test_rerun_with_fewer_events(spark, tmp_path, write_raw, overwrite):
    """A re-run is computed from its own rows, never from partitions that an older run left."""
    out, jan = str(tmp_path / "t"), T.MonthRange.one("202401")
    def run(rows):
        return jobs.run_enrich(spark, events_df(spark, rows), out, jan, "both", overwrite=overwrite, write_raw=write_raw)

    early, late = _level("u1", "2024-01-05 06:10:00"), _level("u1", "2024-01-05 08:10:00")
    run([early, late, _ad("u1", "2024-01-05 06:20:00")])
    res = run([early])
    day = tables.read_rollup(spark, out, "daily").collect()
    month = tables.read_rollup(spark, out, "monthly").collect()
    assert [(r.numLevelsCompleted, r.numAdsWatched) for r in day] == [(1, 0)]
    assert [(r.numLevelsCompleted, r.numAdsWatched) for r in month] == [(1, 0)]
    assert res.counts == {HOURLY_TABLE: 1, DAILY_TABLE: 1, MONTHLY_TABLE: 1}
    hours = tables.read_table(spark, res.tables[HOURLY_TABLE], TABLE_SCHEMAS[HOURLY_TABLE]).select("hourOfDay").collect()
    assert sorted(r.hourOfDay for r in hours) == ([6] if overwrite == "period" else [6, 8])


def test_months_without_events_give_empty_tables(spark, tmp_path):
    out = str(tmp_path / "t")
    signup = event(user="u1", ts=ms("2024-01-05 06:10:00"), attribution="organic", action="SIGN_UP")
    res = jobs.run_enrich(spark, events_df(spark, [signup]), out, T.MonthRange.one("202401"), "both")
    assert set(res.counts.values()) == {0} and all(p.count() == 0 for p in res.previews.values())
    for name in (HOURLY_TABLE, DAILY_TABLE, MONTHLY_TABLE):
        assert tables.read_table(spark, res.tables[name], TABLE_SCHEMAS[name]).count() == 0
    assert tables.read_raw_players(spark, out).count() == 1
    # and a period that loses all its events loses its rows
    jan = T.MonthRange.one("202401")
    jobs.run_enrich(spark, events_df(spark, [_level("u1", "2024-01-05 06:10:00")]), out, jan, "both")
    assert tables.read_rollup(spark, out, "daily").count() == 1
    jobs.run_enrich(spark, events_df(spark, [signup]), out, jan, "both")
    assert tables.read_rollup(spark, out, "daily").count() == 0 == tables.read_rollup(spark, out, "monthly").count()


def test_raw_table_has_few_files_whatever_the_tasks(spark, tmp_path):
    import pathlib
    from collections import Counter
    ev = load_game_events(spark, SF_SMALL).repartition(32)
    res = jobs.run_enrich(spark, ev, str(tmp_path / "t"), T.MonthRange("202401", "202403"), "daily")
    per_dir = Counter(f.parent for f in pathlib.Path(res.tables[RAW_TABLE]).rglob("*.parquet"))
    assert len(per_dir) > 50 and max(per_dir.values()) <= 2


def test_scratch_is_deleted(spark, tmp_path):
    import pathlib
    from playerlytics.session import checkpoint_dir
    base = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    jobs.run_enrich(spark, load_game_events(spark, SF_SMALL), str(tmp_path / "t"), T.MonthRange.one("202401"), "daily")
    assert not list(base.glob("scratch-enrich-*"))


def test_a_game_must_be_named_or_none(spark, enriched):
    out, _ = enriched
    with pytest.raises(ValueError):
        jobs.run_elbow(spark, out, "", T.MonthRange.one("202401"), 2, 3)


def test_projection_of_the_stored_clusters(spark, enriched, tmp_path):
    out, _ = enriched
    seg = jobs.run_segmentation(spark, out, "GAME_A", T.MonthRange("202401", "202403"), 3, str(tmp_path / "m"), str(tmp_path / "c"))
    points = jobs.run_projection(spark, seg.clusters_path).collect()
    assert len(points) == seg.labelled.count() and all(len(r.points) == 2 for r in points)
    assert {r.cluster for r in points} == {r.cluster for r in seg.labelled.select("cluster").distinct().collect()}


def test_monthly_only_enrich(spark, tmp_path):
    from playerlytics import MonthRange, run_enrich
    out = str(tmp_path / "monthly")
    res = run_enrich(spark, load_game_events(spark, SF_SMALL), out, MonthRange("202401", "202403"), "monthly")
    assert set(res.tables) == {RAW_TABLE, MONTHLY_TABLE}
    preview = res.previews[MONTHLY_TABLE].collect()
    assert len(preview) == 15 and preview[0].codMonth == 202403
    assert [r.codMonth for r in preview] == sorted((r.codMonth for r in preview), reverse=True)
    assert res.counts[MONTHLY_TABLE] == tables.read_rollup(spark, out, "monthly").count()
