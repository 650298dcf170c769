"""Lifetime value (L1-L8) over cluster-labelled daily rows.

revenue = ad_value x ads watched; ARPDAU = revenue / active count of the period;
LTV of a player in a period = ARPDAU x lifetime (parts of day active that day, or days
active that month).

``active="flag"`` (default) keeps the batch job's definition: the number of distinct
values of ``numLevelsCompleted > 0`` in the period, i.e. 1 or 2. ``active="users"``
counts distinct players with a completed level. A zero count gives a null LTV
(``try_divide``), never a division error.

The series (L5, L6, L8) need no join: from one row per (game[, cluster], player, period) with its
revenue, lifetime and whether it has completed levels, one aggregation per period gives the sum of
revenue x lifetime and the active count, and the sum and mean of LTV by division. For LTV per
player (L4, L7) the active counts, one row per game and period, are written under
``spark.checkpoint.dir`` and joined from there, so that the engine knows their size: it broadcasts
them if small, and otherwise can split a hot period, as both sides of the join are plain shuffles.
The per-cluster series (L6) adds ``cluster`` to every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time as T
from ..functions.aggregates import exact_avg, exact_sum
from ..session import scratch_path

# Fixed value: revenue per watched ad, in dollars.
AD_VALUE = 0.015


def _active(mode: str) -> Column:
    if mode == "flag":
        return F.count_distinct(F.col("numLevelsCompleted") > 0)
    if mode == "users":
        return F.count_distinct(F.when(F.col("numLevelsCompleted") > 0, F.col("userId")))
    raise ValueError("active must be 'flag' or 'users'")


def _revenue(ad_value: float) -> Column:
    return (F.sum("numAdsWatched") * F.lit(ad_value)).alias("revenue")


def ltv_by_cluster(labelled: DataFrame, ad_value: float = AD_VALUE) -> DataFrame:
    """LTV per cluster = revenue of its rows / distinct players in it (L1)."""
    return (labelled.groupBy("gameId", "cluster")
            .agg(F.count_distinct("userId").alias("uniqueUsers"), _revenue(ad_value))
            .select("gameId", "cluster", F.try_divide(F.col("revenue"), F.col("uniqueUsers")).alias("ltv")))


def user_day_revenue(rows: DataFrame, by: tuple[str, ...] = (), ad_value: float = AD_VALUE) -> DataFrame:
    """Per player and date: lifetime = parts of day present, revenue (L2)."""
    return (rows.groupBy("gameId", *by, "userId", "date")
            .agg(F.count("partOfDay").alias("lifetime"), _revenue(ad_value)))


def active_per_day(rows: DataFrame, by: tuple[str, ...] = (), active: str = "flag") -> DataFrame:
    """Active count per date (L3)."""
    return rows.groupBy("gameId", *by, "date").agg(_active(active).alias("activeUsersPerPeriod"))


def _ltv(per_user: DataFrame, per_period: DataFrame, keys: list[str], period: str) -> DataFrame:
    spark = per_user.sparkSession
    path = scratch_path(spark, "active")
    per_period.write.parquet(path)
    joined = per_user.join(spark.read.schema(per_period.schema).parquet(path), keys, "left")
    ltv = F.try_divide(F.col("revenue"), F.col("activeUsersPerPeriod")) * F.col("lifetime")
    extra = [c for c in keys if c not in ("gameId", period)]
    return joined.select("gameId", *extra, "userId", ltv.alias("ltv"), period)


def _series(rows: DataFrame, keys: list[str], lifetime: Column, active: str, ad_value: float) -> DataFrame:
    """Sum and mean LTV per period without a join (see above)."""
    if active not in ("flag", "users"):
        raise ValueError("active must be 'flag' or 'users'")
    done = F.col("numLevelsCompleted") > 0
    per_user = rows.groupBy(*keys, "userId").agg(
        lifetime.alias("lifetime"), _revenue(ad_value),
        F.max(done.cast("int")).alias("some"), F.max((~done).cast("int")).alias("idle"))
    value = F.col("revenue") * F.col("lifetime")
    count = (F.coalesce(F.max("some"), F.lit(0)) + F.coalesce(F.max("idle"), F.lit(0)) if active == "flag"
             else F.sum(F.when(F.col("userId").isNotNull(), F.col("some")).otherwise(F.lit(0))))
    per_period = per_user.groupBy(*keys).agg(exact_sum(value).alias("total"), F.count(value).alias("n"), count.alias("active"))
    total = F.try_divide(F.col("total"), F.col("active").cast("double"))
    return per_period.select(*keys, total.alias("sumLtv"), F.try_divide(total, F.col("n").cast("double")).alias("avgLtv")).orderBy(*keys)


def ltv_user_daily(rows: DataFrame, by: tuple[str, ...] = (), active: str = "flag",
                   ad_value: float = AD_VALUE) -> DataFrame:
    """LTV per player and date (L4); ``by=("cluster",)`` computes it within each cluster."""
    keys = ["gameId", *by, "date"]
    return _ltv(user_day_revenue(rows, by, ad_value), active_per_day(rows, by, active), keys, "date")


def ltv_points(ltv: DataFrame, period: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Sum and mean per period of given LTV rows, ordered (of a stored table: L8)."""
    keys = ["gameId", *by, period]
    return (ltv.groupBy(*keys)
            .agg(exact_sum(F.col("ltv")).alias("sumLtv"), exact_avg(F.col("ltv")).alias("avgLtv"))
            .orderBy(*keys))


def ltv_points_daily(rows: DataFrame, active: str = "flag", ad_value: float = AD_VALUE) -> DataFrame:
    return _series(rows, ["gameId", "date"], F.count("partOfDay"), active, ad_value)


def ltv_points_daily_by_cluster(rows: DataFrame, active: str = "flag", ad_value: float = AD_VALUE) -> DataFrame:
    """The daily series of each cluster, active count taken within the cluster."""
    return _series(rows, ["gameId", "cluster", "date"], F.count("partOfDay"), active, ad_value)


def with_month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("codMonth", T.cod_month(F.col("date")))


def user_month_revenue(rows: DataFrame, ad_value: float = AD_VALUE) -> DataFrame:
    """Per player and month: lifetime = distinct active dates, revenue."""
    return (with_month(rows).groupBy("gameId", "userId", "codMonth")
            .agg(F.count_distinct("date").alias("lifetime"), _revenue(ad_value)))


def active_per_month(rows: DataFrame, active: str = "flag") -> DataFrame:
    return with_month(rows).groupBy("gameId", "codMonth").agg(_active(active).alias("activeUsersPerPeriod"))


def ltv_user_monthly(rows: DataFrame, active: str = "flag", ad_value: float = AD_VALUE) -> DataFrame:
    """LTV per player and month."""
    return _ltv(user_month_revenue(rows, ad_value), active_per_month(rows, active),
                ["gameId", "codMonth"], "codMonth")


def ltv_points_monthly(rows: DataFrame, active: str = "flag", ad_value: float = AD_VALUE) -> DataFrame:
    return _series(with_month(rows), ["gameId", "codMonth"], F.count_distinct("date"), active, ad_value)
