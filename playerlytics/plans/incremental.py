"""Rollups kept up by batches of new events (E1, A1, A5-A7), published together (``sources.versions``).

A batch gives partial counters per player and hour. They are added to the stored counters of the dates that the batch
touches, and only these dates, and the months they are of, are written anew. The stored
hours keep every hour with its number of level events, so that an hour whose ads came before its
levels counts as if all had come at once. Registration lives in a player table of small appended runs (first
sign-up, organic flag, months with rows), which are merged when read and compacted when many; when a batch changes a
player's registration, the dates that hold rows of that player are written anew too. The files of
a batch are recorded by the commit that publishes it, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import time as T
from ..functions.bounded import bounded_rows
from ..operators import activity, clean, rollup
from ..session import scratch
from ..sources.schemas import (DAILY_TABLE, EVENT_SCHEMA, HOURLY_TABLE, HOURLY_ROLLUP_SCHEMA, MEASURES, MONTHLY_TABLE, RAW_TABLE,
                               STORE_PARTITIONS, TABLE_SCHEMAS)
from ..sources.versions import PLAYER_SORT, Store, month_of_part, player_filters

# Names of the tables that only this module reads.
STATE_TABLE, PLAYER_TABLE, APPLIED_TABLE, ACTIVITY_TABLE = "hour_state", "players", "applied", "activity"
_KEYS = [HOURLY_ROLLUP_SCHEMA[c] for c in ("userId", "gameId", "hourOfDay")]
STATE_SCHEMA = StructType([*_KEYS, StructField("_levels", LongType()), *[HOURLY_ROLLUP_SCHEMA[m] for m in MEASURES],
                           StructField("date", DateType())])
PLAYER_SCHEMA = StructType([*_KEYS[:2], StructField("flagOrganic", IntegerType()), StructField("dateRegistration", DateType()),
                            StructField("months", ArrayType(StringType()))])
ACTIVITY_SCHEMA = activity.MASK_SCHEMA
APPLIED_SCHEMA = StructType([StructField("file", StringType())])
#: Dates that one batch may touch, and files that it may hold.
MOST_DATES, MOST_FILES = 100_000, 1_000_000
#: Appended runs of the player table that are compacted into one.
PLAYER_RUNS = 8


@dataclass
class BatchResult:
    commit: int | None      # None: every file had been applied before
    files: int
    dates: int              # dates that the batch has rows of
    corrected: int          # further dates rewritten for a changed registration


def read(spark: SparkSession, base: str, table: str, commit: int | None = None) -> DataFrame:
    """A published table with its declared schema, as of a commit (the latest one)."""
    return Store(spark, base).read(table, TABLE_SCHEMAS[table], commit)


def _dates_in(dates: Sequence, column: str = "part") -> Column:
    return F.col(column).isin([f"date={d}" for d in dates])


def read_activity(spark: SparkSession, base: str) -> DataFrame:
    """Days of activity, events and sign-ups per player and month (``operators.activity``), for retention of any month."""
    return Store(spark, base).read(ACTIVITY_TABLE, ACTIVITY_SCHEMA)


def player_registry(store: Store) -> DataFrame:
    """One row per player of the merged runs: flagOrganic and dateRegistration (null without a sign-up), months with rows."""
    return merged_players(store.read(PLAYER_TABLE, PLAYER_SCHEMA))


def merged_players(rows: DataFrame) -> DataFrame:
    months = F.array_sort(F.array_distinct(F.flatten(F.collect_list("months"))))
    return rows.groupBy("userId", "gameId").agg(F.max("flagOrganic").alias("flagOrganic"),
                                                F.min("dateRegistration").alias("dateRegistration"), months.alias("months"))


def _batch_players(cleaned: DataFrame, hours: DataFrame) -> DataFrame:
    """What the batch says of players: sign-ups, and the months that they have rows in. Null keys never join, so are left out."""
    signed = rollup.registration(clean.family_rows(cleaned, "player")).withColumn("months", F.lit(None).cast("array<string>"))
    seen = hours.select("userId", "gameId", T.cod_month(F.col("date")).alias("m")).distinct() \
        .groupBy("userId", "gameId").agg(F.collect_set("m").alias("months")) \
        .select("userId", "gameId", F.lit(None).cast("int").alias("flagOrganic"), F.lit(None).cast("date").alias("dateRegistration"), "months")
    rows = signed.unionByName(seen).where("userId IS NOT NULL AND gameId IS NOT NULL")
    none = F.array().cast("array<string>")
    return merged_players(rows.withColumn("months", F.coalesce("months", none)))


def apply_events(spark: SparkSession, events: DataFrame, base: str, files: DataFrame | None = None,
                 on_bad_timezone: str = "error", write_raw: bool = True) -> BatchResult:
    """Add a batch of events to the tables under ``base`` and publish all of them in one commit.

    ``files`` (column file) names what the batch consists of; the names are recorded by the commit. The caller passes
    events of new files only (``apply_new_files`` sees to it). Everything is derived from the batch and the
    partitions that it touches. An empty batch commits its files alone.
    """
    store = Store(spark, base)
    run = store.begin()
    with scratch(spark, "batch") as work:
        def own(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        cleaned = own("cleaned", clean.clean_events(events, None, on_bad_timezone))
        delta = own("hours", rollup.hour_state(cleaned))
        dates = [r.date for r in bounded_rows(delta.select("date").distinct().orderBy("date"), MOST_DATES)]

        before = player_registry(store)
        news = own("players", _batch_players(cleaned, delta))
        old = before.select("userId", "gameId", F.col("flagOrganic").alias("_flag"), F.col("dateRegistration").alias("_date"),
                            F.col("months").alias("_months"))
        both = news.join(old, ["userId", "gameId"], "left")
        changed = (F.coalesce(F.col("flagOrganic") > F.coalesce(F.col("_flag"), F.lit(-1)), F.lit(False))
                   | F.coalesce(F.col("dateRegistration") < F.coalesce(F.col("_date"), F.lit("9999-12-31").cast("date")), F.lit(False)))
        grown = F.size(F.array_except("months", F.coalesce("_months", F.array().cast("array<string>")))) > 0
        delta_players = own("changed", both.where(changed | grown).select(*news.columns, changed.alias("changed"), "_months"))
        affected = own("affected", delta_players.where("changed").select("userId", "gameId", F.explode("_months").alias("m")))
        months = [r.m for r in bounded_rows(affected.select("m").distinct().orderBy("m"), MOST_DATES)]
        late = []
        if months:  # only the months that the players have rows in are looked at
            keys = store.read(STATE_TABLE, STATE_SCHEMA, parts=month_of_part().isin(months))
            held = keys.join(affected.select("userId", "gameId").distinct(), ["userId", "gameId"], "left_semi").select("date").distinct()
            late = [r.date for r in bounded_rows(held.orderBy("date"), MOST_DATES) if r.date not in set(dates)]

        if write_raw:
            run.append(RAW_TABLE, cleaned.select(*TABLE_SCHEMAS[RAW_TABLE].names), STORE_PARTITIONS[RAW_TABLE])
        touched = sorted([*dates, *late])
        if touched:
            # hours of late dates are merged already; each table is read from the folder that the run wrote it to
            state = store.read(STATE_TABLE, STATE_SCHEMA, parts=_dates_in(late))
            if dates:
                stored_rows = store.read(STATE_TABLE, STATE_SCHEMA, parts=_dates_in(dates))
                merged = rollup.merged_hours(stored_rows.unionByName(delta.select(*STATE_SCHEMA.names)))
                state = state.unionByName(run.replace(STATE_TABLE, merged, ("date",), _dates_in(dates)))
            registry = merged_players(before.unionByName(delta_players.select(*before.columns)))
            hourly = rollup.hourly_from_state(state, registry.where("flagOrganic IS NOT NULL"))
            hourly = run.replace(HOURLY_TABLE, hourly.select(*TABLE_SCHEMAS[HOURLY_TABLE].names), ("date",), _dates_in(touched), player_filters(), PLAYER_SORT)
            daily = rollup.daily_rollup(hourly).select(*TABLE_SCHEMAS[DAILY_TABLE].names)
            daily = run.replace(DAILY_TABLE, daily, ("date",), _dates_in(touched), player_filters(), PLAYER_SORT)
            codes = sorted({f"{d:%Y%m}" for d in touched})
            others = store.read(DAILY_TABLE, TABLE_SCHEMAS[DAILY_TABLE], parts=~_dates_in(touched) & month_of_part().isin(codes))
            monthly = rollup.monthly_rollup(daily.select(*others.columns).unionByName(others))
            monthly = monthly.withColumn("codMonth", F.col("codMonth").cast("int")).select(*TABLE_SCHEMAS[MONTHLY_TABLE].names)
            run.replace(MONTHLY_TABLE, monthly, ("codMonth",), F.col("part").isin([f"codMonth={c}" for c in codes]), player_filters(), PLAYER_SORT)
        masks = own("masks", activity.masks(clean.family_rows(cleaned, "player"), delta))
        codes = [r.m for r in bounded_rows(masks.select(F.col("codMonth").cast("string").alias("m")).distinct(), MOST_DATES)]
        if codes:
            scope = month_of_part().isin(codes)
            held = store.read(ACTIVITY_TABLE, ACTIVITY_SCHEMA, parts=scope)
            run.replace(ACTIVITY_TABLE, activity.merged(held.unionByName(masks)), ("codMonth",), scope, player_filters(), PLAYER_SORT)
        _add_players(store, run, before, delta_players.select(*before.columns))
        n = 0
        if files is not None:
            run.append(APPLIED_TABLE, files.select("file").coalesce(1))
            n = files.count()
        return BatchResult(run.commit(), n, len(dates), len(late))


def _add_players(store: Store, run, before: DataFrame, rows: DataFrame) -> None:
    """Append the batch's players as a run of the player table; many runs become one."""
    if store.partitions(PLAYER_TABLE).count() + 1 < PLAYER_RUNS:
        run.append(PLAYER_TABLE, rows)
    else:
        run.replace(PLAYER_TABLE, merged_players(before.unionByName(rows)), ())


def new_files(spark: SparkSession, source: str, base: str, fmt: str = "parquet", schema: StructType = EVENT_SCHEMA) -> DataFrame:
    """Files (column file) under ``source`` that no commit of the store has applied."""
    listed = spark.read.format(fmt).schema(schema).load(source).inputFiles()
    if len(listed) > MOST_FILES:
        raise RuntimeError(f"more than {MOST_FILES} files")
    return (spark.createDataFrame([(f,) for f in sorted(listed)], APPLIED_SCHEMA)
            .join(Store(spark, base).read(APPLIED_TABLE, APPLIED_SCHEMA), "file", "left_anti"))


def apply_new_files(spark: SparkSession, source: str, base: str, fmt: str = "parquet", schema: StructType = EVENT_SCHEMA,
                    **options) -> BatchResult:
    """Apply the events of the files under ``source`` that have not been applied yet; each file counts once."""
    files = [r.file for r in bounded_rows(new_files(spark, source, base, fmt, schema), MOST_FILES)]
    if not files:
        return BatchResult(None, 0, 0, 0)
    events = spark.read.format(fmt).schema(schema).load(files)
    return apply_events(spark, events, base, spark.createDataFrame([(f,) for f in files], APPLIED_SCHEMA), **options)
