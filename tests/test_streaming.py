from pyspark.sql import functions as F

from conftest import SF_SMALL
from playerlytics.functions import time as T
from playerlytics.plans import jobs
from playerlytics.sources import tables
from playerlytics.sources.fixtures import load_game_events
from playerlytics.sources.schemas import EVENT_SCHEMA
from playerlytics.streaming.rerun import enrich_on_arrival, touched_months


def test_stream_rerun_matches_batch(spark, tmp_path):
    ev = load_game_events(spark, SF_SMALL).select(*EVENT_SCHEMA.fieldNames())
    jan_end = T.MonthRange.one("202401").epoch_ms_bounds()[1]
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    ev.where(F.col("timestamp") < jan_end).write.parquet(src + "/part1")
    q = enrich_on_arrival(spark, src + "/*", out, checkpoint=ck, write_raw=False)
    q.awaitTermination(300)
    first = tables.read_rollup(spark, out, "daily")
    assert first.count() > 0 and first.agg(F.max("date")).first()[0].month == 1
    # later files: February and March events arrive
    ev.where(F.col("timestamp") >= jan_end).write.parquet(src + "/part2")
    q = enrich_on_arrival(spark, src + "/*", out, checkpoint=ck, write_raw=False)
    q.awaitTermination(300)
    got = tables.read_rollup(spark, out, "daily")
    want_dir = str(tmp_path / "batch")
    jobs.run_enrich(spark, ev, want_dir, T.MonthRange("202401", "202403"), "daily", write_raw=False)
    want = tables.read_rollup(spark, want_dir, "daily")
    # February/March rows equal a batch run over all events
    feb_on = F.col("date") >= F.lit("2024-02-01").cast("date")
    assert got.where(feb_on).exceptAll(want.where(feb_on)).count() == 0
    assert want.where(feb_on).exceptAll(got.where(feb_on)).count() == 0
    assert got.where(~feb_on).count() == want.where(~feb_on).count()


def test_touched_months(spark):
    df = spark.createDataFrame([(1704067200000,), (1709251200000,)], "timestamp long")
    odd = spark.createDataFrame([(10 ** 17,), (-10 ** 14,), (None,)], "timestamp long")
    assert touched_months(df.union(odd)) == [T.MonthRange.one("202401"), T.MonthRange.one("202403")]
    assert touched_months(df.where("timestamp < 0")) == []
