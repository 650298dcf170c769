"""Tables published together: a run that stops leaves every table as it was; commits, history, vacuum, skipping."""

import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from conftest import SF_SMALL, event, events_df, ms
from playerlytics.functions import time as T
from playerlytics.plans import jobs
from playerlytics.sources import tables, versions
from playerlytics.sources.fixtures import load_game_events
from playerlytics.sources.schemas import DAILY_TABLE, HOURLY_TABLE, MONTHLY_TABLE, RAW_TABLE, TABLE_SCHEMAS

SCHEMA = StructType([StructField("k", LongType()), StructField("date", DateType())])


def rows(spark, *pairs):
    return spark.createDataFrame([(k, d) for k, d in pairs], "k long, d string").select("k", F.col("d").cast("date").alias("date"))


def held(store, commit=None):
    return sorted((r.k, str(r.date)) for r in store.read("t", SCHEMA, commit).toLocalIterator())


def test_commits_replace_append_and_keep_history(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "s"))
    assert not store.exists() and held(store) == []
    run = store.begin()
    run.replace("t", rows(spark, (1, "2024-01-01"), (2, "2024-01-02"), (3, None)), ("date",))
    assert held(store) == []
    assert run.commit() == 1
    run = store.begin()
    run.append("t", rows(spark, (4, "2024-01-01")), ("date",))
    run.replace("t", rows(spark, (5, "2024-01-03")), ("date",), F.col("part") == "date=2024-01-02")
    assert run.commit() == 2
    assert held(store) == [(1, "2024-01-01"), (3, "None"), (4, "2024-01-01"), (5, "2024-01-03")]
    run = store.begin()
    run.replace_present("t", rows(spark, (6, "2024-01-01")), ("date",))
    run.commit()
    assert held(store) == [(3, "None"), (5, "2024-01-03"), (6, "2024-01-01")]
    assert held(store, 1) == [(1, "2024-01-01"), (2, "2024-01-02"), (3, "None")]
    plan = store.read("t", SCHEMA).where("date = '2024-01-03'")
    assert "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().executedPlan().toString()


def test_the_second_of_two_concurrent_runs_is_refused(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "s"))
    one, two = store.begin(), store.begin()
    one.replace("t", rows(spark, (1, "2024-01-01")), ("date",))
    two.replace("t", rows(spark, (2, "2024-01-01")), ("date",))
    one.commit()
    with pytest.raises(versions.ConcurrentCommit):
        two.commit()
    assert held(store) == [(1, "2024-01-01")] and store.commits() == [1]


def test_vacuum_removes_what_no_commit_names(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "s"))
    for k in range(3):
        run = store.begin()
        run.replace("t", rows(spark, (k, "2024-01-01")), ("date",))
        run.append("u", rows(spark, (k, "2024-01-01")))
        run.commit()
    lost = store.begin()
    lost.replace("t", rows(spark, (9, "2024-01-01")), ("date",))  # never committed
    store.vacuum()
    assert store.commits() == [3] and held(store) == [(2, "2024-01-01")]
    assert len(list((tmp_path / "s" / "t").iterdir())) == 1 and len(list((tmp_path / "s" / "u").iterdir())) == 3
    assert len(list((tmp_path / "s" / "_manifest").iterdir())) == 1


def test_odd_partition_values_are_refused(spark, tmp_path):
    run = versions.Store(spark, str(tmp_path / "s")).begin()
    run.replace("t", spark.createDataFrame([(1, "a/b")], "k long, p string"), ("p",))
    with pytest.raises(Exception, match="cannot name a folder"):
        run.commit()


def snapshot(spark, out):
    found = {t: sorted(map(str, tables.read_published(spark, out, t, TABLE_SCHEMAS[t]).toLocalIterator()))
             for t in (RAW_TABLE, HOURLY_TABLE, DAILY_TABLE, MONTHLY_TABLE)}
    assert all(found.values())
    return found


@pytest.mark.parametrize("at", [DAILY_TABLE])
def test_a_run_that_stops_between_tables_changes_none(spark, tmp_path, monkeypatch, at):
    out = str(tmp_path / "store")
    early = [event(user="u1", ts=ms("2024-01-05 06:10:00"), levelId="L", status="COMPLETED"),
             event(user="u1", ts=ms("2024-01-01 06:10:00"), attribution="organic", action="SIGN_UP")]
    later = early + [event(user="u2", ts=ms("2024-01-06 07:10:00"), levelId="L", status="STARTED")]
    jan = T.MonthRange.one("202401")
    jobs.run_enrich(spark, events_df(spark, early), out, jan, "both", publish="versions")
    before = snapshot(spark, out)
    write = versions.Run._write

    def stops(self, table, *args):
        out = write(self, table, *args)
        if table == at:
            raise RuntimeError("stopped")
        return out

    monkeypatch.setattr(versions.Run, "_write", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        jobs.run_enrich(spark, events_df(spark, later), out, jan, "both", publish="versions")
    assert snapshot(spark, out) == before
    monkeypatch.setattr(versions.Run, "_write", write)
    assert jobs.run_enrich(spark, events_df(spark, later), out, jan, "both", publish="versions").commit == 2
    assert snapshot(spark, out) != before


def test_enrich_into_a_store_equals_plain_tables(spark, tmp_path):
    ev = load_game_events(spark, SF_SMALL)
    plain, store = str(tmp_path / "plain"), str(tmp_path / "store")
    jobs.run_enrich(spark, ev, plain, T.MonthRange("202401", "202403"), "both")
    jobs.run_enrich(spark, ev, store, T.MonthRange("202401", "202403"), "both", publish="versions")
    for g in ("daily", "monthly"):
        names = tables.GRANULARITY_TABLE[g][2].names
        a, b = (tables.read_rollup(spark, d, g).select(*names) for d in (plain, store))
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count() and a.count() > 0
    assert tables.read_raw_players(spark, plain).count() == tables.read_raw_players(spark, store).count()
    # a month's re-run replaces that month alone, gone partitions included; "dynamic" keeps those without rows
    feb = T.MonthRange.one("202402")
    fewer = ev.where(F.dayofmonth(T.date_from_epoch_ms(F.col("timestamp"))) < 10)
    n = {m: tables.read_rollup(spark, store, "daily").where(F.month("date") == m).count() for m in (1, 2, 3)}
    jobs.run_enrich(spark, fewer, store, feb, "daily", publish="versions", overwrite="dynamic", write_raw=False)
    assert tables.read_rollup(spark, store, "daily").where("date = '2024-02-20'").count() > 0
    jobs.run_enrich(spark, fewer, store, feb, "daily", publish="versions", write_raw=False)
    after = tables.read_rollup(spark, store, "daily")
    assert after.where("month(date) = 2 AND day(date) >= 10").count() == 0 < after.where("month(date) = 2").count() < n[2]
    assert after.where("month(date) <> 2").count() == n[1] + n[3]


def test_jobs_read_a_store_and_model_all_games(spark, tmp_path):
    out, months = str(tmp_path / "store"), T.MonthRange("202401", "202403")
    jobs.run_enrich(spark, load_game_events(spark, SF_SMALL), out, months, "both", publish="versions")
    costs = jobs.run_elbow(spark, out, None, months, 2, 3).toPandas()
    assert sorted(zip(costs.gameId, costs.kCluster)) == [(g, k) for g in ("GAME_A", "GAME_B") for k in (2, 3)]
    seg = jobs.run_segmentation(spark, out, None, months, 3, str(tmp_path / "models"), str(tmp_path / "clusters"))
    assert seg.centers.count() == 6 and seg.labelled.count() > 0
    points = jobs.run_projection(spark, seg.clusters_path, by_game=True)
    assert points.count() == seg.labelled.count() and set(points.columns) == {"gameId", "points", "cluster"}
    assert jobs.run_retention(spark, out, "GAME_A", "202401", 3)["points"].count() > 0


def test_rows_of_a_file_are_ordered_and_filtered(spark, tmp_path):
    """Files are ordered by game and player and carry Bloom filters on players: a read of an absent player reads no rows."""
    import pyarrow.parquet as pq
    store = versions.Store(spark, str(tmp_path / "s"))
    schema = StructType.fromDDL("userId string, gameId string, n long, date date")
    df = spark.range(40_000).selectExpr("concat('u', lpad(pmod(id * 7919, 40000), 6, '0')) userId", "if(id % 2 = 0, 'A', 'B') gameId",
                                        "id n", "date'2024-01-01' date")
    run = store.begin()
    run.replace("t", df, ("date",), None, {**versions.player_filters(), "parquet.block.size": str(64 << 10)}, versions.PLAYER_SORT)
    run.commit()
    for f in pathlib.Path(tmp_path / "s" / "t").rglob("*.parquet"):
        t = pq.read_table(f, partitioning=None).to_pydict()
        keys = list(zip(t["gameId"], t["userId"]))
        assert keys == sorted(keys)
        groups = pq.ParquetFile(f).metadata
        games = [(groups.row_group(i).column(1).statistics.min, groups.row_group(i).column(1).statistics.max) for i in range(groups.num_row_groups)]
        assert groups.num_row_groups > 2 and sum(a != b for a, b in games) <= 1  # a group holds one game, but for the one between

    def rows_read(condition):
        """Rows that the query returns, and rows of the row groups that its scan did not skip."""
        out = store.read("t", schema).where(condition)
        n = len(out.toArrow())
        scan = out._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return n, scan.metrics().apply("numOutputRows").value()

    found, read = rows_read("gameId = 'A'")
    assert found == 20_000 <= read < 32_000  # the other game's row groups are skipped by their statistics
    found, read = rows_read("userId = 'u000123'")
    assert found == 1 <= read < 20_000  # each game's groups are ordered by player
    found, read = rows_read("userId = 'u0001230'")
    assert found == 0 == read  # in the range of some group, in none of the Bloom filters
