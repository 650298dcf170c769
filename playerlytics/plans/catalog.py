"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per checked operator.

Each query derives the game events from the given ``events`` table (see
``sources.fixtures``) and composes library operators lazily, so Catalyst sees one plan
per query. Doubles are rounded to 6 places at the very end, only so the result can be
hashed against the SQL oracle; the library functions themselves never round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import time as T
from ..operators import activity, clean, distinct, game_models, ltv, profile, retention, rollup, segment
from ..session import scratch_path
from ..sources import documents, sinks, tables
from ..sources.events import behavior_source, player_info_source
from ..sources.fixtures import game_events, load_game_events
from ..sources.schemas import DAILY_TABLE, EVENT_SCHEMA, MONTHLY_TABLE, RAW_TABLE, TABLE_PARTITIONS
from . import incremental, jobs

# Parameters of the registered queries. Rollups and analyses run over all months and games
# (gameId is a group key, of models too); the game/range filter operators are
# checked with GAME over FILTER_MONTHS.
GAME = "GAME_A"
FILTER_MONTHS = T.MonthRange("202401", "202402")
# Given centres over the five raw features, for deterministic cluster labels.
FIXED_CENTROIDS = ((0, 0, 0, 1, 0), (1, 0, 0, 2, 0), (1, 1, 1, 3, 1))
KMEANS_K = 4
RETENTION_START = "202401"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def stable(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (for value hashing only).

    Snapped to 12 places first, so last-bit noise of a value on a rounding boundary
    (e.g. 0.0021875) rounds the same way in every engine.
    """
    return df.select(*[F.round(F.round(F.col(f.name), 12), places).alias(f.name)
                       if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


# --- shared inputs ------------------------------------------------------------------------

_EVENTS: dict[str, tuple[SparkSession, DataFrame]] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's raw game events (two SQL projections of ``events``).

    Reused within one session (saves re-listing the folder when a query needs the
    events twice); a different session object always gets a fresh DataFrame.
    """
    key = str(sf_dir)
    cached = _EVENTS.get(key)
    if cached is None or cached[0] is not spark:
        cached = (spark, load_game_events(spark, key))
        _EVENTS[key] = cached
    return cached[1]


def player_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_info_source(events(spark, sf_dir))


def behavior(spark: SparkSession, sf_dir: str, months: T.MonthRange | None = None) -> DataFrame:
    return behavior_source(events(spark, sf_dir), months)


def hourly(spark: SparkSession, sf_dir: str, months: T.MonthRange | None = None) -> DataFrame:
    return rollup.hourly_rollup(player_info(spark, sf_dir), behavior(spark, sf_dir, months))


def daily(spark: SparkSession, sf_dir: str, months: T.MonthRange | None = None) -> DataFrame:
    return rollup.daily_rollup(hourly(spark, sf_dir, months))


# --- time functions (F4-F10) -------------------------------------------------------------

@query("fn_time")
def q_fn_time(spark, sf_dir):
    raw = game_events(spark.read.parquet(f"{str(sf_dir).rstrip('/')}/events.parquet"), slotted=False)
    clock = T.utc_wall_clock(F.col("timestamp"))
    tz = T.clean_timezone(F.col("timezone"))
    hour = T.local_hour(clock, tz)
    return raw.select(
        "eventId", tz.alias("timezone"), T.date_of(clock).alias("date"),
        T.datetime_text(clock).alias("datetime"), hour.alias("hourOfDay"),
        T.part_of_day(hour).alias("partOfDay"),
        T.part_of_day_number(T.part_of_day(hour)).alias("partOfDayNumber"),
        T.day_of_week(T.date_of(clock)).alias("dayOfWeek"),
        T.cod_month(T.date_of(clock)).alias("codMonth"))


# --- sources (S1, S4, S5) ------------------------------------------------------------------

@query("src_events")
def q_src_events(spark, sf_dir):
    return stable(events(spark, sf_dir).select("eventId", *EVENT_SCHEMA.fieldNames()))


@query("src_player_info")
def q_src_player_info(spark, sf_dir):
    return player_info(spark, sf_dir)


@query("src_behavior")
def q_src_behavior(spark, sf_dir):
    b = behavior(spark, sf_dir)
    return stable(b.withColumn("datetime", T.datetime_text(F.col("datetime"))))


# --- cleaning (P1-P4) ----------------------------------------------------------------------

@query("clean_players")
def q_clean_players(spark, sf_dir):
    return clean.clean_players(player_info(spark, sf_dir))


@query("clean_levels")
def q_clean_levels(spark, sf_dir):
    return clean.clean_levels(behavior(spark, sf_dir))


@query("clean_ads")
def q_clean_ads(spark, sf_dir):
    return clean.clean_ads(behavior(spark, sf_dir))


@query("clean_purchases")
def q_clean_purchases(spark, sf_dir):
    return stable(clean.clean_purchases(behavior(spark, sf_dir)))


# --- family aggregates (A1-A4) and joins (J1-J3) -----------------------------------------

@query("agg_registration")
def q_agg_registration(spark, sf_dir):
    return rollup.registration(clean.clean_players(player_info(spark, sf_dir)))


@query("agg_levels_hourly")
def q_agg_levels_hourly(spark, sf_dir):
    return rollup.family_hourly(clean.clean_levels(behavior(spark, sf_dir)), "level")


@query("agg_ads_hourly")
def q_agg_ads_hourly(spark, sf_dir):
    return rollup.family_hourly(clean.clean_ads(behavior(spark, sf_dir)), "ad")


@query("agg_purchases_hourly")
def q_agg_purchases_hourly(spark, sf_dir):
    return stable(rollup.family_hourly(clean.clean_purchases(behavior(spark, sf_dir)), "purchase"))


def _levels_hourly(spark, sf_dir):
    return rollup.family_hourly(clean.clean_levels(behavior(spark, sf_dir)), "level")


@query("join_levels_players")
def q_join_levels_players(spark, sf_dir):
    reg = rollup.registration(clean.clean_players(player_info(spark, sf_dir)))
    return _levels_hourly(spark, sf_dir).join(reg, list(rollup.USER_KEYS), "left")


@query("join_levels_ads")
def q_join_levels_ads(spark, sf_dir):
    ads = rollup.family_hourly(clean.clean_ads(behavior(spark, sf_dir)), "ad")
    return _levels_hourly(spark, sf_dir).join(ads, list(rollup.HOUR_KEYS), "left")


@query("join_levels_purchases")
def q_join_levels_purchases(spark, sf_dir):
    purchases = rollup.family_hourly(clean.clean_purchases(behavior(spark, sf_dir)), "purchase")
    return stable(_levels_hourly(spark, sf_dir).join(purchases, list(rollup.HOUR_KEYS), "left"))


# --- rollups (A5-A7, T1) -------------------------------------------------------------------

@query("rollup_hourly")
def q_rollup_hourly(spark, sf_dir):
    return stable(hourly(spark, sf_dir))


@query("rollup_daily")
def q_rollup_daily(spark, sf_dir):
    return stable(daily(spark, sf_dir))


@query("rollup_monthly")
def q_rollup_monthly(spark, sf_dir):
    # months straight from hours (one aggregation fewer); the oracle goes through days
    return stable(rollup.monthly_rollup(hourly(spark, sf_dir)))


@query("preview_latest_daily")
def q_preview_latest_daily(spark, sf_dir):
    return stable(rollup.preview_latest(daily(spark, sf_dir), 15))


# --- analysis inputs (S6-S8) -----------------------------------------------------------------

def players_clean(spark, sf_dir):
    return clean.clean_players(player_info(spark, sf_dir))


def seg_input(spark, sf_dir, game_id=None, months=None):
    return tables.segmentation_input(daily(spark, sf_dir), "daily", game_id, months)


def clusters(spark, sf_dir, game_id=None, months=None):
    """Cluster-labelled daily rows, labels from the fixed centres."""
    labelled = segment.assign_to_centroids(seg_input(spark, sf_dir, game_id, months), FIXED_CENTROIDS)
    return tables.cluster_input(labelled, "daily", game_id, months)


@query("src_game_player_events")
def q_src_game_player_events(spark, sf_dir):
    return tables.game_player_events(players_clean(spark, sf_dir), GAME, FILTER_MONTHS)


@query("src_game_daily")
def q_src_game_daily(spark, sf_dir):
    return seg_input(spark, sf_dir, GAME, FILTER_MONTHS)


@query("src_game_monthly")
def q_src_game_monthly(spark, sf_dir):
    monthly = rollup.monthly_rollup(daily(spark, sf_dir))
    return tables.segmentation_input(monthly, "monthly", GAME, FILTER_MONTHS)


@query("src_game_cluster")
def q_src_game_cluster(spark, sf_dir):
    return clusters(spark, sf_dir, GAME, FILTER_MONTHS)


# --- segmentation (M1-M11) -----------------------------------------------------------------

@query("seg_features")
def q_seg_features(spark, sf_dir):
    return seg_input(spark, sf_dir)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("seg_scaled_features")
def q_seg_scaled_features(spark, sf_dir):
    rows = game_models.scaled_features(seg_input(spark, sf_dir))
    return stable(rows.select("userId", "gameId", "date", "partOfDay",
                              *[F.col(segment.SCALED_COL)[i].alias(f"s_{f}") for i, f in enumerate(segment.FEATURES)]))


@query("seg_assign_fixed")
def q_seg_assign_fixed(spark, sf_dir):
    return segment.assign_to_centroids(seg_input(spark, sf_dir), FIXED_CENTROIDS)


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All games' rows with their cluster, and the games' models."""
    features = seg_input(spark, sf_dir)
    models, _ = game_models.fit(features, [KMEANS_K])
    return game_models.label(features, models), models


@query("seg_kmeans")
def q_seg_kmeans(spark, sf_dir):
    return _labelled(spark, sf_dir)[0].drop(segment.FEATURE_COL, segment.SCALED_COL)


@query("seg_centers")
def q_seg_centers(spark, sf_dir):
    found = game_models.centres(game_models.fit(seg_input(spark, sf_dir), [KMEANS_K])[0])
    return stable(found.select("gameId", "cluster", *[F.col("center")[i].alias(f) for i, f in enumerate(segment.FEATURES)]))


@query("seg_elbow")
def q_seg_elbow(spark, sf_dir):
    return stable(game_models.elbow(seg_input(spark, sf_dir)))


@query("seg_pca")
def q_seg_pca(spark, sf_dir):
    points = game_models.pca_points(_labelled(spark, sf_dir)[0], keep=("userId", "date", "partOfDay"))
    return stable(points.select("gameId", "userId", "date", "partOfDay", "cluster",
                                F.col("points")[0].alias("x"), F.col("points")[1].alias("y")))


@query("seg_kmeans_check")
def q_seg_kmeans_check(spark, sf_dir):
    """Per game: rows, rows not at their nearest centre, labels out of range."""
    rows, models = _labelled(spark, sf_dir)
    own = models.select("gameId", F.transform("centres", lambda c: F.zip_with(c, "factors", lambda a, f: a * f)).alias("_c"))

    def squared(c):
        return F.aggregate(F.zip_with(c, segment.SCALED_COL, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)

    near = rows.join(own, "gameId").withColumn("_d", F.transform("_c", squared))
    return near.groupBy("gameId").agg(
        F.count("*").alias("numRows"), F.count_if(F.get("_d", F.col("cluster")) > F.array_min("_d") + F.lit(1e-9)).alias("notNearest"),
        F.count_if(~F.col("cluster").between(0, F.size("_c") - 1)).alias("badLabels"))


@query("seg_elbow_check")
def q_seg_elbow_check(spark, sf_dir):
    """Per game and k: whether the training cost is the sum of squared distances to the model's centres."""
    models, vectors = game_models.fit(seg_input(spark, sf_dir), range(segment.DEFAULT_ELBOW_K[0], segment.DEFAULT_ELBOW_K[1] + 1))
    centres = game_models.centres(models).select("gameId", "k", "center")
    scaled = vectors.join(models.select("gameId", "factors").distinct(), "gameId").withColumn("v", F.zip_with("x", "factors", lambda x, f: x * f))
    squared = F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    again = (scaled.join(centres, "gameId").groupBy("gameId", "k", "x", "w").agg(F.min(squared).alias("d"))
             .groupBy("gameId", F.col("k").alias("kCluster")).agg(F.sum(F.col("w") * F.col("d")).alias("again")))
    same = F.abs(F.col("costTraining") - F.col("again")) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.col("again"))
    return game_models.costs(models, vectors).join(again, ["gameId", "kCluster"]).select("gameId", "kCluster", same.alias("costMatches"))


@query("seg_pca_check")
def q_seg_pca_check(spark, sf_dir):
    """Per game: rows, whether the two components are uncorrelated, and whether the first varies more."""
    p = game_models.pca_points(_labelled(spark, sf_dir)[0])
    x, y = F.col("points")[0], F.col("points")[1]
    stats = p.groupBy("gameId").agg(F.count("*").alias("numRows"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("xy"))
    return stats.select("gameId", "numRows", (F.abs("xy") <= 1e-6 * F.sqrt(F.col("vx") * F.col("vy")) + 1e-9).alias("uncorrelated"),
                        (F.col("vx") >= F.col("vy")).alias("falling"))


# --- cluster profiles (A13-A19, T3) ----------------------------------------------------------

@query("cluster_users")
def q_cluster_users(spark, sf_dir):
    return profile.users_per_cluster(clusters(spark, sf_dir))


@query("cluster_feature_summary")
def q_cluster_feature_summary(spark, sf_dir):
    return stable(profile.feature_summary(clusters(spark, sf_dir)))


@query("cluster_active_players")
def q_cluster_active_players(spark, sf_dir):
    return profile.active_players(clusters(spark, sf_dir))


@query("cluster_avg_levels")
def q_cluster_avg_levels(spark, sf_dir):
    return stable(profile.avg_levels_completed(clusters(spark, sf_dir)))


@query("cluster_avg_ads")
def q_cluster_avg_ads(spark, sf_dir):
    return stable(profile.avg_ads_watched(clusters(spark, sf_dir)))


@query("cluster_organic_users")
def q_cluster_organic_users(spark, sf_dir):
    return profile.organic_users(clusters(spark, sf_dir))


@query("cluster_ids")
def q_cluster_ids(spark, sf_dir):
    return profile.cluster_ids(clusters(spark, sf_dir))


@query("cluster_sample")
def q_cluster_sample(spark, sf_dir):
    return profile.cluster_sample(clusters(spark, sf_dir), 20)


# --- lifetime value (L1-L8) ---------------------------------------------------------------

@query("ltv_by_cluster")
def q_ltv_by_cluster(spark, sf_dir):
    return stable(ltv.ltv_by_cluster(clusters(spark, sf_dir)))


@query("ltv_user_day_revenue")
def q_ltv_user_day_revenue(spark, sf_dir):
    return stable(ltv.user_day_revenue(clusters(spark, sf_dir)))


@query("ltv_active_per_day")
def q_ltv_active_per_day(spark, sf_dir):
    return ltv.active_per_day(clusters(spark, sf_dir), active="flag")


@query("ltv_active_users_per_day")
def q_ltv_active_users_per_day(spark, sf_dir):
    return ltv.active_per_day(clusters(spark, sf_dir), active="users")


@query("ltv_user_daily")
def q_ltv_user_daily(spark, sf_dir):
    return stable(ltv.ltv_user_daily(clusters(spark, sf_dir)))


@query("ltv_user_daily_active_users")
def q_ltv_user_daily_active_users(spark, sf_dir):
    return stable(ltv.ltv_user_daily(clusters(spark, sf_dir), active="users"))


@query("ltv_points_daily")
def q_ltv_points_daily(spark, sf_dir):
    return stable(ltv.ltv_points_daily(clusters(spark, sf_dir)))


@query("ltv_points_daily_by_cluster")
def q_ltv_points_daily_by_cluster(spark, sf_dir):
    return stable(ltv.ltv_points_daily_by_cluster(clusters(spark, sf_dir)))


@query("ltv_user_monthly")
def q_ltv_user_monthly(spark, sf_dir):
    return stable(ltv.ltv_user_monthly(clusters(spark, sf_dir)))


@query("ltv_points_monthly")
def q_ltv_points_monthly(spark, sf_dir):
    return stable(ltv.ltv_points_monthly(clusters(spark, sf_dir)))


# --- retention (A8-A12, R1-R4, J6) --------------------------------------------------------

def _cohort_events(spark, sf_dir, cohort="any"):
    return retention.cohort_events(players_clean(spark, sf_dir), RETENTION_START, cohort)


@query("retention_new_users")
def q_retention_new_users(spark, sf_dir):
    return retention.new_users(_cohort_events(spark, sf_dir))


@query("retention_activity")
def q_retention_activity(spark, sf_dir):
    lo, hi = retention.activity_range(RETENTION_START, 0)
    d = daily(spark, sf_dir)
    return retention.daily_activity(d.where(F.col("date").between(F.lit(lo), F.lit(hi))))


@query("retention_cohorts")
def q_retention_cohorts(spark, sf_dir):
    return retention.cohort_members(_cohort_events(spark, sf_dir))


@query("cohort_activity")
def q_cohort_activity(spark, sf_dir):
    lo, hi = retention.activity_range(RETENTION_START, 3)
    d = daily(spark, sf_dir)
    act = retention.daily_activity(d.where(F.col("date").between(F.lit(lo), F.lit(hi))))
    return retention.cohort_activity(retention.cohort_members(_cohort_events(spark, sf_dir)), act,
                                     T.days_in_month(RETENTION_START), 3)


@query("retention_grid")
def q_retention_grid(spark, sf_dir):
    return retention.retention_grid(retention.new_users(_cohort_events(spark, sf_dir)),
                                    T.days_in_month(RETENTION_START))


def _points(spark, sf_dir, idle, **kw):
    # activity is a per-day sum of level counters: hourly rows give the same sums as the
    # daily rollup without its aggregation (the oracle goes through days)
    return retention.retention_points(players_clean(spark, sf_dir), hourly(spark, sf_dir),
                                      RETENTION_START, idle, **kw)


@query("retention_points")
def q_retention_points(spark, sf_dir):
    return stable(_points(spark, sf_dir, 0))


@query("retention_points_idle3")
def q_retention_points_idle3(spark, sf_dir):
    return stable(_points(spark, sf_dir, 3))


@query("retention_points_full_horizon")
def q_retention_points_full_horizon(spark, sf_dir):
    return stable(_points(spark, sf_dir, 3, full_horizon=True))


@query("retention_points_signup")
def q_retention_points_signup(spark, sf_dir):
    return stable(_points(spark, sf_dir, 0, cohort="signup"))


@query("retention_monthly_avg")
def q_retention_monthly_avg(spark, sf_dir):
    return stable(retention.monthly_average(_points(spark, sf_dir, 0), RETENTION_START))


@query("retention_monthly_avg_cohorts")
def q_retention_monthly_avg_cohorts(spark, sf_dir):
    return stable(retention.monthly_average(_points(spark, sf_dir, 3), RETENTION_START, "cohorts"))


# --- sinks (S9, S10) ---------------------------------------------------------------------
# Written under the cluster's shared checkpoint folder (spark.checkpoint.dir), a fresh
# path per call, then read back with the declared read schema.

REWRITE_MONTH = T.MonthRange.one("202401")


@query("sink_roundtrip")
def q_sink_roundtrip(spark, sf_dir):
    base = scratch_path(spark, "roundtrip")
    sinks.write_partitioned(daily(spark, sf_dir), tables.table_path(base, DAILY_TABLE),
                            TABLE_PARTITIONS[DAILY_TABLE], "static")
    return stable(tables.read_rollup(spark, base, "daily"))


@query("sink_dynamic_overwrite")
def q_sink_dynamic_overwrite(spark, sf_dir):
    """Write all days, then re-run January for one game only with dynamic overwrite:
    January partitions the re-run touches are replaced, all others are kept."""
    base = scratch_path(spark, "dynamic")
    path = tables.table_path(base, DAILY_TABLE)
    parts = TABLE_PARTITIONS[DAILY_TABLE]
    full = _stored(daily(spark, sf_dir), "daily")
    sinks.write_partitioned(full, path, parts, "dynamic")
    rerun = full.where(REWRITE_MONTH.date_filter(F.col("date")) & (F.col("gameId") == GAME))
    sinks.write_partitioned(rerun, path, parts, "dynamic")
    return stable(tables.read_rollup(spark, base, "daily"))


@query("rollup_hourly_any")
def q_rollup_hourly_any(spark, sf_dir):
    """Hourly rollup keeping every hour with any behaviour event (``driver="any"``)."""
    return stable(rollup.hourly_rollup(player_info(spark, sf_dir), behavior(spark, sf_dir), driver="any"))


@query("src_monthly_rollup")
def q_src_monthly_rollup(spark, sf_dir):
    """Monthly rollup written by (codMonth, partOfDay), read back with its declared schema:
    ``codMonth`` is text when built and an int when read (S2, S16)."""
    base = scratch_path(spark, "monthly")
    sinks.write_partitioned(rollup.monthly_rollup(daily(spark, sf_dir)), tables.table_path(base, MONTHLY_TABLE),
                            TABLE_PARTITIONS[MONTHLY_TABLE], "static")
    return stable(tables.read_rollup(spark, base, "monthly"))


# --- whole instants, and the jobs' written tables (E1, E3-E5) ---------------------------------------

def _unslotted(spark, sf_dir) -> DataFrame:
    """Hourly rollup of the events at their own instants."""
    raw = game_events(spark.read.parquet(f"{str(sf_dir).rstrip('/')}/events.parquet"), slotted=False)
    return rollup.hourly_rollup(player_info_source(raw), behavior_source(raw))


@query("rollup_hourly_unslotted")
def q_rollup_hourly_unslotted(spark, sf_dir):
    return stable(_unslotted(spark, sf_dir))


@query("rollup_daily_unslotted")
def q_rollup_daily_unslotted(spark, sf_dir):
    return stable(rollup.daily_rollup(_unslotted(spark, sf_dir)))


_ENRICHED: dict[str, tuple[SparkSession, str]] = {}


def _enriched(spark, sf_dir, fresh: bool = False) -> str:
    """The tables of ``run_enrich`` over all events, under the shared checkpoint folder.

    Written once per session for the queries that only read them; ``fresh`` gives tables of its own.
    """
    cached = _ENRICHED.get(str(sf_dir))
    if not fresh and cached is not None and cached[0] is spark:
        return cached[1]
    base = scratch_path(spark, "enriched")
    jobs.run_enrich(spark, events(spark, sf_dir), base, None, "daily")
    if not fresh:
        _ENRICHED[str(sf_dir)] = (spark, base)
    return base


@query("enrich_rerun_shrunk")
def q_enrich_rerun_shrunk(spark, sf_dir):
    """Enrich all events, then again without purchases and without the second half of every day."""
    base = _enriched(spark, sf_dir, fresh=True)
    hour = F.pmod(F.floor(F.col("timestamp") / 3_600_000), F.lit(24))
    fewer = events(spark, sf_dir).where(F.col("amount").isNull() & (hour < 12))
    jobs.run_enrich(spark, fewer, base, None, "daily")
    return stable(tables.read_rollup(spark, base, "daily"))


@query("raw_family_roundtrip")
def q_raw_family_roundtrip(spark, sf_dir):
    """Rows and distinct players of each cleaned family as the raw table holds them."""
    base = scratch_path(spark, "raw")
    sinks.write_partitioned(clean.clean_events(events(spark, sf_dir), None), tables.table_path(base, RAW_TABLE),
                            TABLE_PARTITIONS[RAW_TABLE])
    parts = [tables.read_raw_family(spark, base, f).agg(F.lit(f).alias("family"), F.count("*").alias("numRows"),
                                                        F.count_distinct("userId").alias("numUsers"),
                                                        F.count_distinct("date").alias("numDates")) for f in clean.FAMILY_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("job_retention")
def q_job_retention(spark, sf_dir):
    """``run_retention`` of one game over the written tables."""
    return stable(jobs.run_retention(spark, _enriched(spark, sf_dir), GAME, RETENTION_START, 3)["points"])


def _cluster_table(spark, sf_dir) -> str:
    """All games' daily rows of the written tables, labelled by the fixed centres and written."""
    rows = tables.segmentation_input(tables.read_rollup(spark, _enriched(spark, sf_dir), "daily"), "daily")
    path = scratch_path(spark, "clusters")
    sinks.write_partitioned(segment.assign_to_centroids(rows, FIXED_CENTROIDS), path, ["date", "partOfDay"])
    return path


@query("job_ltv_daily")
def q_job_ltv_daily(spark, sf_dir):
    """``run_ltv`` per player and day over a written cluster table: the series of each cluster."""
    found = jobs.run_ltv(spark, _cluster_table(spark, sf_dir), None, None, "user", "daily")
    return stable(found["ltv_points_daily_by_cluster"])


@query("job_cluster_profile")
def q_job_cluster_profile(spark, sf_dir):
    """The feature summary over a written cluster table."""
    rows = tables.cluster_input(tables.read_table(spark, _cluster_table(spark, sf_dir)), "daily")
    return stable(profile.feature_summary(rows))


@query("job_enrich_monthly")
def q_job_enrich_monthly(spark, sf_dir):
    """The monthly table of ``run_enrich`` in a store, as its readers resolve it."""
    base = scratch_path(spark, "store")
    jobs.run_enrich(spark, events(spark, sf_dir), base, None, "both", publish="versions", write_raw=False)
    return stable(tables.read_rollup(spark, base, "monthly"))


@query("job_ltv_monthly")
def q_job_ltv_monthly(spark, sf_dir):
    """``run_ltv`` per player and month over a written cluster table, through its own written table."""
    found = jobs.run_ltv(spark, _cluster_table(spark, sf_dir), None, None, "user", "monthly", monthly_out=scratch_path(spark, "ltv"))
    return stable(found["ltv_points_monthly"].withColumn("codMonth", F.col("codMonth").cast("string")))


# --- rollups kept up by batches (E1, A1, A5-A7, S9, S10) ----------------------------------------------

def _in_batches(spark, sf_dir) -> str:
    """All events applied as three batches of files, each replayed once: two halves of the behaviour, then all sign-ups."""
    base, source = scratch_path(spark, "store"), scratch_path(spark, "batches")
    rows = events(spark, sf_dir)
    signup, half = F.col("attribution").isNotNull(), F.pmod(F.xxhash64("userId", "timestamp", "status"), F.lit(2))
    for i, part in enumerate((~signup & (half == 0), ~signup & (half == 1), signup)):
        rows.where(part).select(*EVENT_SCHEMA.fieldNames()).write.parquet(f"{source}/{i}")
        for _ in range(2):
            incremental.apply_new_files(spark, f"{source}/*", base, write_raw=False)
    return base


@query("incremental_daily")
def q_incremental_daily(spark, sf_dir):
    """The daily table after three batches and their replays; every sign-up came after all the days that it changes."""
    return stable(tables.read_rollup(spark, _in_batches(spark, sf_dir), "daily"))


@query("incremental_monthly")
def q_incremental_monthly(spark, sf_dir):
    return stable(tables.read_rollup(spark, _in_batches(spark, sf_dir), "monthly"))


@query("incremental_retention")
def q_incremental_retention(spark, sf_dir):
    """Retention with three idle days from the activity table that the batches kept up."""
    return stable(activity.retention_points(incremental.read_activity(spark, _in_batches(spark, sf_dir)), RETENTION_START, 3))


# --- retention from a stored activity table, distinct players from stored bitmaps ----------------------

def _activity(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "activity")
    sinks.write_partitioned(activity.masks(players_clean(spark, sf_dir), hourly(spark, sf_dir)), path, ["codMonth"])
    return spark.read.schema(activity.MASK_SCHEMA).parquet(path)


@query("retention_stored")
def q_retention_stored(spark, sf_dir):
    return stable(activity.retention_points(_activity(spark, sf_dir), RETENTION_START, 0))


@query("retention_stored_idle3")
def q_retention_stored_idle3(spark, sf_dir):
    return stable(activity.retention_points(_activity(spark, sf_dir), RETENTION_START, 3))


@query("retention_stored_full_horizon")
def q_retention_stored_full_horizon(spark, sf_dir):
    return stable(activity.retention_points(_activity(spark, sf_dir), RETENTION_START, 3, full_horizon=True))


@query("retention_stored_signup")
def q_retention_stored_signup(spark, sf_dir):
    return stable(activity.retention_points(_activity(spark, sf_dir), RETENTION_START, 0, cohort="signup"))


def _bitmaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored bitmaps of the players of each group; the players are numbered in two runs, January's first."""
    none = rows.sparkSession.createDataFrame([], distinct.NUMBER_SCHEMA)
    first = _stored(distinct.new_numbers(none, rows.where(F.col(keys[-1]) < F.lit("2024-02-01").cast("date"))), "numbers")
    numbers = _stored(first.unionByName(distinct.new_numbers(first, rows)), "numbers")
    return _stored(distinct.bitmaps(rows, numbers, keys), "bitmaps")


@query("bitmap_cluster_users")
def q_bitmap_cluster_users(spark, sf_dir):
    """Players per cluster, or-ed from bitmaps per day and cluster."""
    return distinct.distinct_players(_bitmaps(clusters(spark, sf_dir), ["gameId", "cluster", "date"]), ["gameId", "cluster"], "numberOfUsers")


@query("bitmap_monthly_users")
def q_bitmap_monthly_users(spark, sf_dir):
    """Players per game and month, or-ed from the same bitmaps."""
    parts = _bitmaps(clusters(spark, sf_dir), ["gameId", "cluster", "date"])
    return distinct.distinct_players(parts.withColumn("codMonth", T.cod_month(F.col("date"))), ["gameId", "codMonth"], "numberOfUsers")


@query("bitmap_new_users")
def q_bitmap_new_users(spark, sf_dir):
    rows = _cohort_events(spark, sf_dir).withColumnRenamed("date", "pivotDate").select("gameId", "userId", "pivotDate")
    return distinct.distinct_players(_bitmaps(rows, ["gameId", "pivotDate"]), ["gameId", "pivotDate"], "newUsers")


# --- a collection of documents whose types drift (S1, S17, S18) ---------------------------------------

def _drifting(rows: DataFrame) -> DataFrame:
    """Events as JSON lines, some with other types, without their time, cut off or not an object."""
    names = EVENT_SCHEMA.fieldNames()

    def line(**other):
        return F.to_json(F.struct(*[other.get(n, F.col(n)).alias(n) for n in names if other.get(n, 0) is not None]))

    def every(k):
        return F.pmod(F.col("eventId"), F.lit(k)) == 0

    text, time = F.when, F.col("timestamp")
    return rows.select(
        text(every(17), F.expr("left(to_json(struct(userId, timestamp)), 12)")).when(every(29), F.lit("[1, 2]"))
        .when(every(13), line(amount=F.lit("n/a"))).when(every(19), line(timestamp=None)).when(every(23), line(userId=F.struct(F.lit(1).alias("id"))))
        .when(every(31), line(timestamp=time + 0.5)).when(every(11), line(timestamp=time.cast("string"), levelId=F.lit(7)))
        .otherwise(line()).alias("value"))


@query("documents_by_reason")
def q_documents_by_reason(spark, sf_dir):
    """Events written as drifting JSON lines and read back: good documents, and those set aside by reason."""
    path = scratch_path(spark, "documents")
    _drifting(events(spark, sf_dir)).write.text(path)
    rows = _stored(documents.read_collection(spark, path), "documents")
    good = documents.good_events(rows).agg(F.lit("good").alias("outcome"), F.count("*").alias("numDocuments"),
                                           F.sum("timestamp").alias("sumTimestamp"), F.count_if(F.col("levelId") == "7").alias("numRenamed"))
    rest = documents.quarantined(rows).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("numDocuments"))
    return good.unionByName(rest, allowMissingColumns=True)
