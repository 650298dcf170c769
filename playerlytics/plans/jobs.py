"""End-to-end jobs (E1-E5) on the caller's SparkSession, with typed parameters.

Each stage starts from files that the run itself wrote (a lineage cut: a lost executor
re-reads Parquet instead of recomputing the events).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import time as T
from ..functions.bounded import bounded_rows
from ..operators import clean, game_models, ltv, profile, retention, rollup, segment
from ..session import scratch
from ..sources import sinks, tables
from ..sources.schemas import DAILY_TABLE, HOURLY_TABLE, MONTHLY_TABLE, RAW_TABLE, STORE_PARTITIONS, TABLE_PARTITIONS, TABLE_SCHEMAS
from ..sources.versions import PLAYER_SORT, Store, month_of_part, player_filters

GRANULARITIES = ("daily", "monthly", "both")


@dataclass
class EnrichResult:
    tables: dict[str, str] = field(default_factory=dict)     # table name -> path
    counts: dict[str, int] = field(default_factory=dict)     # rows written this run (A20)
    previews: dict[str, DataFrame] = field(default_factory=dict)  # latest 15 rows (T1)
    commit: int | None = None                                 # of a store


def _months_of(df: DataFrame, months: T.MonthRange | None, period: str) -> DataFrame:
    return df if months is None else df.where(months.date_filter(F.col("date")) if period == "date" else months.code_filter(F.col("codMonth")))


def run_enrich(spark: SparkSession, events: DataFrame, out: str, months: T.MonthRange | None,
               granularity: str = "daily", driver: str = "levels", on_bad_timezone: str = "error",
               overwrite: str = "period", write_raw: bool = True, publish: str = "in_place") -> EnrichResult:
    """Clean the events, roll them up and write the tables.

    ``months`` limits the behaviour events (None: all). ``granularity``: "daily" writes the hourly and daily rollups, "monthly" the monthly
    one, "both" all three. Every table is derived from this run's own rows, which are kept in
    a scratch folder under ``spark.checkpoint.dir`` until the tables are published; what older
    runs left in the tables is never read. ``overwrite="period"`` (default) replaces the
    run's months in the rollup tables, partitions that have no rows any more included;
    ``"dynamic"`` replaces only the partitions that this run has rows for.

    ``publish="in_place"`` replaces one table after the other. ``"versions"`` makes ``out`` a store
    (``sources.versions``): the tables are written beside the old ones and become visible together, in one commit,
    after the last one; a run that stops before leaves all of them as they were. The readers of ``sources.tables``
    take either. A store's tables are partitioned by date or month alone.

    The source is read once: the four cleaned families are written as one table (published
    with ``write_raw``, partitioned by (family, date)), and the rollups read it. Months
    without events give tables without rows.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    if overwrite not in ("period", "dynamic", "static"):
        raise ValueError("overwrite must be 'period', 'dynamic' or 'static'")
    if publish not in ("in_place", "versions"):
        raise ValueError("publish must be 'in_place' or 'versions'")
    res = EnrichResult()
    run = Store(spark, out).begin() if publish == "versions" else None

    def own(work: str, name: str, df: DataFrame) -> DataFrame:
        """This run's rows of a table, written once."""
        path = f"{work}/{name}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def stage(name: str, rows: DataFrame) -> None:
        """A table of this run, in a version of its own."""
        rows, columns = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLE_SCHEMAS[name].fields]), STORE_PARTITIONS[name]
        if overwrite == "dynamic" or overwrite == "period" and name == RAW_TABLE:
            run.replace_present(name, rows, columns, player_filters(), PLAYER_SORT)
        else:
            all_months = overwrite == "static" or months is None
            scope = F.lit(True) if all_months else month_of_part().between(months.from_month, months.to_month)
            run.replace(name, rows, columns, scope, player_filters(), PLAYER_SORT)

    def put(name: str, rows: DataFrame) -> None:
        path = tables.table_path(out, name)
        partitions, schema = list(TABLE_PARTITIONS[name]), TABLE_SCHEMAS[name]
        if run:
            stage(name, rows)
        else:
            sinks.write_partitioned(rows, path, partitions, "static" if overwrite == "static" else "dynamic")
        res.tables[name] = path
        if name == RAW_TABLE:
            return
        if overwrite == "period" and not run:
            kept = _months_of(tables.read_table(spark, path, schema), months, partitions[0])
            sinks.drop_stale_partitions(path, kept, rows.select(*[F.col(c).cast(schema[c].dataType) for c in partitions]), partitions)
        res.counts[name] = rows.count()
        latest = rollup.preview_latest(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]))
        res.previews[name] = spark.createDataFrame(bounded_rows(latest, rollup.PREVIEW_ROWS), schema)

    with scratch(spark, "enrich") as work:
        cleaned = own(work, RAW_TABLE, clean.clean_events(events, months, on_bad_timezone))
        if write_raw:
            put(RAW_TABLE, cleaned)
        hourly = own(work, HOURLY_TABLE, rollup.hourly_rollup_from_clean(cleaned, months, driver))
        if granularity in ("daily", "both"):
            put(HOURLY_TABLE, hourly)
            put(DAILY_TABLE, own(work, DAILY_TABLE, rollup.daily_rollup(hourly)))
        if granularity in ("monthly", "both"):
            # months straight from hours: the same sums as through days, one shuffle fewer
            put(MONTHLY_TABLE, own(work, MONTHLY_TABLE, rollup.monthly_rollup(hourly)))
        if run:
            res.commit = run.commit()
    return res


def _features(spark: SparkSession, base: str, game_id: str | None, months: T.MonthRange | None,
              granularity: str) -> DataFrame:
    if game_id == "":
        raise ValueError("game_id must name a game (None: all games)")
    rollup_df = tables.read_rollup(spark, base, granularity)
    return tables.segmentation_input(rollup_df, granularity, game_id, months)


def run_elbow(spark: SparkSession, base: str, game_id: str | None, months: T.MonthRange | None,
              k_from: int = segment.DEFAULT_ELBOW_K[0], k_to: int = segment.DEFAULT_ELBOW_K[1],
              granularity: str = "daily") -> DataFrame:
    """Training cost for each k over one game's rollup rows (E2); without ``game_id`` of every game, in one plan."""
    if game_id is None:
        return game_models.elbow(_features(spark, base, None, months, granularity), k_from, k_to)
    return segment.elbow(_features(spark, base, game_id, months, granularity), k_from, k_to)


@dataclass
class SegmentationResult:
    model_path: str
    clusters_path: str
    centers: DataFrame
    labelled: DataFrame
    profiles: dict[str, DataFrame]


def run_segmentation(spark: SparkSession, base: str, game_id: str | None, months: T.MonthRange | None, k: int,
                     model_out: str, clusters_out: str, granularity: str = "daily") -> SegmentationResult:
    """Fit k-means, save the model and the labelled rows, return cluster profiles.

    Without ``game_id`` a model of every named game is fitted in one plan (``operators.game_models``), saved as a table.
    """
    features = _features(spark, base, game_id, months, granularity)
    if game_id is None:
        game_models.save_models(game_models.fit(features, [k])[0], model_out)
        models = game_models.load_models(spark, model_out)
        labelled, centers = game_models.label(features, models), game_models.centres(models)
    else:
        model = segment.fit_segmentation(features, k)
        sinks.save_model(model, model_out)
        labelled, centers = segment.vectors_as_arrays(segment.label(model, features)), segment.cluster_centers(model)
    period = tables.period_column(granularity)
    sinks.write_partitioned(labelled, clusters_out, [period, "partOfDay"], "static")
    back = tables.read_clusters(spark, clusters_out, granularity)
    rows = tables.cluster_input(back, granularity, game_id, months)
    profiles = {
        "users": profile.users_per_cluster(rows),
        "summary": profile.feature_summary(rows),
        "active_players": profile.active_players(rows),
        "avg_levels": profile.avg_levels_completed(rows),
        "avg_ads": profile.avg_ads_watched(rows),
        "organic": profile.organic_users(rows),
        "sample": profile.cluster_sample(rows),
    }
    return SegmentationResult(model_out, clusters_out, centers, back, profiles)


def run_projection(spark: SparkSession, clusters_path: str, k: int = 2, by_game: bool = False) -> DataFrame:
    """PCA of the stored cluster table: ``points`` and ``cluster`` of each row (M9, M10); ``by_game``: of each game's own
    features, with its gameId."""
    if by_game:
        return game_models.pca_points(tables.read_clusters(spark, clusters_path, "daily"), k)
    return segment.pca_points(tables.read_clusters(spark, clusters_path), k)


def run_ltv(spark: SparkSession, clusters_path: str, game_id: str | None, months: T.MonthRange | None,
            attribute: str = "cluster", granularity: str = "daily", active: str = "flag",
            monthly_out: str | None = None) -> dict[str, DataFrame]:
    """LTV by cluster, or by user per day / month.

    Cluster rows are read as daily rows (LTV needs the ``date`` of each row); a table
    labelled on monthly rollups is refused.
    """
    labelled = tables.read_table(spark, clusters_path)
    if "date" not in labelled.columns:
        raise ValueError("LTV needs cluster rows labelled on the daily rollup (a 'date' column)")
    rows = tables.cluster_input(labelled, "daily", game_id, months)
    if attribute == "cluster":
        return {"ltv_by_cluster": ltv.ltv_by_cluster(rows)}
    if attribute != "user":
        raise ValueError("attribute must be 'cluster' or 'user'")
    if granularity == "daily":
        return {"ltv_points_daily": ltv.ltv_points_daily(rows, active),
                "ltv_points_daily_by_cluster": ltv.ltv_points_daily_by_cluster(rows, active)}
    if granularity != "monthly":
        raise ValueError("granularity must be 'daily' or 'monthly'")
    per_user = ltv.ltv_user_monthly(rows, active)
    if monthly_out is not None:
        sinks.write_partitioned(per_user, monthly_out, ["codMonth"], "static")
        schema = StructType([f if f.name != "codMonth" else StructField("codMonth", IntegerType()) for f in per_user.schema.fields])
        per_user = tables.read_table(spark, monthly_out, schema)
    return {"ltv_user_monthly": per_user, "ltv_points_monthly": ltv.ltv_points(per_user, "codMonth")}


def run_retention(spark: SparkSession, base: str, game_id: str | None, start_month: str, idle: int = 0,
                  cohort: str = "any", full_horizon: bool = False,
                  denominator: str = "days") -> dict[str, DataFrame]:
    """N-day retention curves of the start month's cohorts and their average (E5)."""
    month = T.MonthRange.one(start_month)
    players = tables.game_player_events(tables.read_raw_players(spark, base), game_id, month)
    lo, hi = retention.activity_range(start_month, idle, full_horizon)
    activity_months = T.MonthRange(T.month_code(lo), T.month_code(hi))
    daily = tables.read_rollup(spark, base, "daily")
    daily = daily.where(activity_months.date_filter(F.col("date")))
    if game_id is not None:
        daily = daily.where(F.col("gameId") == game_id)
    points = retention.retention_points(players, daily, start_month, idle, cohort, full_horizon)
    return {"points": points, "monthly_avg": retention.monthly_average(points, start_month, denominator)}
