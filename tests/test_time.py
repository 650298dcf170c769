import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import events_df, event, ms
from playerlytics.functions import time as T
from playerlytics.sources.events import behavior_source


def _local(spark, rows):
    df = spark.createDataFrame(rows, "ms long, tz string")
    clock = T.utc_wall_clock(F.col("ms"))
    tz = T.clean_timezone(F.col("tz"))
    h = T.local_hour(clock, tz)
    return df.select("ms", "tz", T.date_of(clock).alias("d"), h.alias("h"),
                     T.part_of_day(h).alias("pod"), T.part_of_day_number(T.part_of_day(h)).alias("podn"),
                     T.day_of_week(T.date_of(clock)).alias("dow"), T.cod_month(T.date_of(clock)).alias("cm"))


def test_utc_date_and_local_hour(spark):
    r = _local(spark, [(ms("2024-01-05 23:30:00"), "+02:00")]).first()
    assert r.d == dt.date(2024, 1, 5) and r.h == 1 and r.pod == "night" and r.podn == 3
    assert r.dow == 6 and r.cm == "202401"   # Friday: 1 = Sunday


def test_timezone_forms(spark):
    rows = [(ms("2024-01-05 10:00:00"), tz) for tz in ("+02.00", "+05:30", "Europe/Warsaw", None, "-03.00")]
    got = {r.tz: r.h for r in _local(spark, rows).collect()}
    assert got == {"+02.00": 12, "+05:30": 15, "Europe/Warsaw": 11, None: 10, "-03.00": 7}


@pytest.mark.parametrize("hour,pod", [(4, "night"), (5, "morning"), (11, "morning"), (12, "afternoon"),
                                      (16, "afternoon"), (17, "evening"), (20, "evening"), (21, "night"),
                                      (23, "night"), (0, "night")])
def test_part_of_day_boundaries(spark, hour, pod):
    r = _local(spark, [(ms(f"2024-01-05 {hour:02d}:00:00"), "+00:00")]).first()
    assert r.pod == pod


def test_session_zone_does_not_matter(spark):
    rows = [(ms("2021-10-01 00:00:00") + 123, "+02:00"), (ms("2024-03-10 07:30:00"), "America/New_York")]
    before = _local(spark, rows).collect()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        after = _local(spark, rows).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after
    assert before[0].d == dt.date(2021, 10, 1) and before[0].h == 2


def test_bad_timezone_modes(spark):
    ev = events_df(spark, [event(ts=ms("2024-01-05 10:00:00"), tz="bogus", levelId="L1", status="STARTED")])
    months = T.MonthRange.one("202401")
    from playerlytics.operators.clean import clean_levels
    with pytest.raises(Exception):
        clean_levels(behavior_source(ev, months)).collect()
    r = clean_levels(behavior_source(ev, months, on_bad_timezone="utc")).first()
    assert r.timezone == "+00:00" and r.hourOfDay == 10


def test_month_range():
    with pytest.raises(ValueError):
        T.MonthRange("202199", "202201")
    with pytest.raises(ValueError):
        T.MonthRange("202402", "202401")
    r = T.MonthRange("202402", "202402")
    assert r.last_day == dt.date(2024, 2, 29)
    lo, hi = r.epoch_ms_bounds()
    assert hi - lo == 29 * 86_400_000


def test_behavior_month_filter_inclusive(spark):
    rows = [event(ts=ms(t), levelId="L1", status="COMPLETED")
            for t in ("2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-02-29 23:59:59", "2024-03-01 00:00:00")]
    b = behavior_source(events_df(spark, rows), T.MonthRange("202401", "202402"))
    assert sorted(r.date for r in b.collect()) == [dt.date(2024, 1, 1), dt.date(2024, 2, 29)]


def test_adapter_is_session_zone_free(spark):
    from conftest import SF_SMALL
    from playerlytics.sources.fixtures import load_game_events, game_events
    raw = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    a = sorted(load_game_events(spark, SF_SMALL).collect())
    b0 = sorted(game_events(raw, slotted=False).select("eventId", "timestamp").collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(load_game_events(spark, SF_SMALL).collect()) == a
        assert sorted(game_events(raw, slotted=False).select("eventId", "timestamp").collect()) == b0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_one_scan_cleaning_bad_zone_scope(spark):
    from playerlytics.operators.clean import clean_events, family_rows
    jan = T.MonthRange.one("202401")
    ok_rows = [event(ts=ms("2024-01-05 10:00:00"), tz="bogus", attribution="organic", action="SIGN_UP"),
               event(ts=ms("2023-12-05 10:00:00"), tz="bogus", levelId="L1", status="STARTED"),
               event(ts=ms("2024-01-05 10:00:00"), tz="+02.00", levelId="L1", status="STARTED")]
    cleaned = clean_events(events_df(spark, ok_rows), jan)
    assert family_rows(cleaned, "player").count() == 1
    assert [r.hourOfDay for r in family_rows(cleaned, "level").collect()] == [12]
    bad = ok_rows + [event(ts=ms("2024-01-06 10:00:00"), tz="bogus", adType="banner", status="WATCHED")]
    with pytest.raises(Exception):
        clean_events(events_df(spark, bad), jan).collect()
    ads = family_rows(clean_events(events_df(spark, bad), jan, on_bad_timezone="utc"), "ad").first()
    assert ads.timezone == "+00:00" and ads.hourOfDay == 10


def test_valid_zones_are_those_that_spark_resolves(spark):
    from playerlytics.functions.time import valid_timezone
    good = ["+02:00", "-05:30", "+8:00", "+18:00", "UTC+3", "GMT-11:30", "EST", "Europe/Paris", "UTC", "Z", "CET"]
    bad = ["+25:00", "+18:30", "+05:75", "Mars/Base", "", "+1:2:3", "nowhere"]
    rows = spark.createDataFrame([(z,) for z in good + bad], "tz string")
    got = {r.tz: r.ok for r in rows.select("tz", valid_timezone(F.col("tz")).alias("ok")).collect()}
    assert [z for z in good if not got[z]] == [] and [z for z in bad if got[z]] == []
    clock = T.utc_wall_clock(F.lit(1_704_110_400_000))   # 2024-01-01 12:00 UTC; none of the good ones may raise
    hours = {r.tz: r.h for r in rows.where(F.col("tz").isin(good)).select("tz", T.local_hour(clock, F.col("tz")).alias("h")).collect()}
    assert hours["EST"] == 7 and hours["+8:00"] == 20 and hours["GMT-11:30"] == 0
