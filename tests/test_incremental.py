"""Rollups kept up by batches: any split of the events, replays and late sign-ups equal one run over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, event, events_df, ms
from playerlytics.operators import rollup
from playerlytics.plans import incremental as N
from playerlytics.plans import jobs
from playerlytics.sources import tables
from playerlytics.sources.fixtures import load_game_events
from playerlytics.sources.schemas import DAILY_TABLE, EVENT_SCHEMA, HOURLY_TABLE, MONTHLY_TABLE, RAW_TABLE, TABLE_SCHEMAS
from playerlytics.sources.versions import Store

ALL = (HOURLY_TABLE, DAILY_TABLE, MONTHLY_TABLE)


def whole(spark, events, out):
    jobs.run_enrich(spark, events, out, None, "both")
    return {t: rows(tables.read_table(spark, tables.table_path(out, t), TABLE_SCHEMAS[t])) for t in ALL}


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*names).toLocalIterator())


def kept(spark, base):
    return {t: rows(N.read(spark, base, t)) for t in ALL}


def test_three_batches_and_replays_equal_one_run(spark, tmp_path):
    ev = load_game_events(spark, SF_SMALL).select("eventId", *EVENT_SCHEMA.fieldNames())
    src, base = str(tmp_path / "src"), str(tmp_path / "store")
    signup = F.col("attribution").isNotNull()
    parts = [~signup & (F.col("eventId") % 2 == 0), ~signup & (F.col("eventId") % 2 == 1), signup]  # sign-ups last of all
    for i, part in enumerate(parts):
        ev.where(part).select(*EVENT_SCHEMA.fieldNames()).coalesce(2).write.parquet(f"{src}/{i}")
        res = N.apply_new_files(spark, src + "/*", base)
        assert res.commit == i + 1 and res.files > 0
        assert N.apply_new_files(spark, src + "/*", base) == N.BatchResult(None, 0, 0, 0)  # a replay
    assert res.dates == 0 and res.corrected > 50
    assert kept(spark, base) == whole(spark, ev, str(tmp_path / "whole"))
    assert N.read(spark, base, RAW_TABLE).count() == tables.read_table(
        spark, tables.table_path(str(tmp_path / "whole"), RAW_TABLE), TABLE_SCHEMAS[RAW_TABLE]).count()


@pytest.mark.parametrize("seed", [0])
def test_any_split_equals_one_run(spark, tmp_path, seed):
    """Hours whose ads come before their levels, null and padded keys, late and earlier sign-ups, empty batches."""
    rng = random.Random(seed)
    found = []
    for _ in range(90):
        user, game = rng.choice([" u1 ", "u1", "u2", "u3", None]), rng.choice(["A", "B", None])
        when = f"2024-0{rng.randint(1, 3)}-0{rng.randint(1, 3)} {rng.choice(['05', '06', '23'])}:30:00"
        kind = rng.choice([{"levelId": "L", "status": "COMPLETED"}, {"levelId": "L", "status": "STARTED"}, {"adType": "x", "status": "WATCHED"},
                           {"amount": 1.25, "itemId": "i", "status": "DONE"}, {"attribution": rng.choice(["organic", "paid"]), "action": "SIGN_UP"},
                           {"attribution": "organic", "action": "LOGIN"}, {}])
        found.append(event(user=user, game=game, ts=ms(when) if rng.random() < 0.95 else None, **kind))
    cuts = sorted(rng.sample(range(len(found)), 3))
    base = str(tmp_path / "store")
    for a, b in zip([0, *cuts, len(found)], [*cuts, len(found), len(found)]):
        N.apply_events(spark, events_df(spark, found[a:b]), base)
    assert kept(spark, base) == whole(spark, events_df(spark, found), str(tmp_path / "whole"))


def test_a_late_sign_up_rewrites_only_what_holds_the_player(spark, tmp_path):
    base = str(tmp_path / "store")
    levels = [event(user=u, ts=ms(f"2024-{m}-05 06:10:00"), levelId="L", status="COMPLETED") for u, m in
              (("u1", "01"), ("u2", "01"), ("u1", "03"), ("u2", "02"))]
    N.apply_events(spark, events_df(spark, levels), base)
    store = Store(spark, base)
    before = {r.part: r.version for r in store.partitions(DAILY_TABLE).toLocalIterator()}
    res = N.apply_events(spark, events_df(spark, [event(user="u1", ts=ms("2023-12-30 00:00:00"), attribution="organic", action="SIGN_UP")]), base)
    after = {r.part: r.version for r in store.partitions(DAILY_TABLE).toLocalIterator()}
    assert (res.dates, res.corrected) == (0, 2)
    assert {p for p in after if after[p] != before[p]} == {"date=2024-01-05", "date=2024-03-05"}
    flags = {(r.userId, str(r.date)): (r.flagOrganic, str(r.dateRegistration)) for r in N.read(spark, base, DAILY_TABLE).toLocalIterator()}
    assert flags[("u1", "2024-03-05")] == (1, "2023-12-30") and flags[("u2", "2024-01-05")] == (0, "None")
    # a later sign-up of the same player changes nothing, so nothing is rewritten
    res = N.apply_events(spark, events_df(spark, [event(user="u1", ts=ms("2024-02-01 00:00:00"), attribution="paid", action="SIGN_UP")]), base)
    assert (res.dates, res.corrected) == (0, 0)


def test_late_sign_ups_merge_no_hours(spark, tmp_path, monkeypatch):
    """A batch of sign-ups alone takes the stored hours as they are; days are built on the hours that the run has written."""
    base, built = str(tmp_path / "store"), []
    levels = [event(user=u, ts=ms(f"2024-01-0{d} 06:10:00"), levelId="L", status="COMPLETED") for u in ("u1", "u2", "u2") for d in (1, 2)]
    signup = [event(user="u1", ts=ms("2023-12-30 00:00:00"), attribution="organic", action="SIGN_UP")]
    N.apply_events(spark, events_df(spark, levels), base)
    store, daily = Store(spark, base), rollup.daily_rollup
    before = rows(store.partitions(N.STATE_TABLE))
    monkeypatch.setattr(N.rollup, "merged_hours", lambda states: pytest.fail("stored hours are merged again"))
    monkeypatch.setattr(N.rollup, "daily_rollup", lambda hourly: built.extend(hourly.inputFiles()) or daily(hourly))
    res = N.apply_events(spark, events_df(spark, signup), base)
    assert (res.dates, res.corrected) == (0, 2) and rows(store.partitions(N.STATE_TABLE)) == before
    assert built and all(f"/{HOURLY_TABLE}/v=" in f for f in built)
    monkeypatch.undo()
    assert kept(spark, base) == whole(spark, events_df(spark, levels + signup), str(tmp_path / "whole"))


def test_history_is_not_read_again(spark, tmp_path):
    """A batch reads the stored partitions of its own dates and months, however many others there are."""
    base = str(tmp_path / "store")
    N.apply_events(spark, events_df(spark, [event(user="u1", ts=ms(f"2024-{m:02d}-{d:02d} 06:10:00"), levelId="L", status="STARTED")
                                            for m in range(1, 7) for d in (3, 4, 5)]), base)
    seen = []
    read = Store.read

    def noted(self, table, schema, commit=None, parts=None):
        out = read(self, table, schema, commit, parts)
        seen.append((table, len(out.inputFiles())))
        return out

    Store.read = noted
    try:
        N.apply_events(spark, events_df(spark, [event(user="u1", ts=ms("2024-05-04 07:00:00"), levelId="L", status="STARTED")]), base)
    finally:
        Store.read = read
    files = dict(seen)
    assert files[N.STATE_TABLE] == 1 and files[DAILY_TABLE] == 2  # of 18 dates: the batch's own, and its month's others


def test_player_runs_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PLAYER_RUNS", 3)
    base = str(tmp_path / "store")
    for i in range(4):
        N.apply_events(spark, events_df(spark, [event(user=f"u{i}", ts=ms("2024-01-05 06:10:00"), levelId="L", status="STARTED"),
                                                event(user="u0", ts=ms(f"2024-01-0{5 - i} 00:00:00"), attribution="organic", action="SIGN_UP")]), base)
    store = Store(spark, base)
    assert store.partitions(N.PLAYER_TABLE).count() < 3
    players = {r.userId: (r.flagOrganic, str(r.dateRegistration), r.months) for r in N.player_registry(store).toLocalIterator()}
    assert players["u0"] == (1, "2024-01-02", ["202401"]) and len(players) == 4


def test_state_keeps_hours_without_levels(spark):
    state = spark.createDataFrame([], N.STATE_SCHEMA)
    assert rollup.merged_hours(state).count() == 0
