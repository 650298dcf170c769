"""Cluster profiles over cluster-labelled rows.

Each profile is one ``groupBy`` over (gameId, cluster[, ...]): the per-cluster loops
of the batch job become group keys. Distinct counts are exact (``count_distinct``);
Spark plans them as a two-level aggregation keyed by the group and ``userId``, so no
group is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import organic_label
from .segment import CLUSTER_COL, FEATURES

SEGMENT_KEYS = ("gameId", CLUSTER_COL)


def users_per_cluster(labelled: DataFrame) -> DataFrame:
    """Distinct players per cluster, ordered by cluster."""
    return (labelled.groupBy(*SEGMENT_KEYS).agg(F.count_distinct("userId").alias("numberOfUsers"))
            .orderBy(*SEGMENT_KEYS))


def feature_summary(labelled: DataFrame) -> DataFrame:
    """count / min / mean / max of each feature per cluster, one pass."""
    aggs = []
    for f in FEATURES:
        aggs += [F.count(f).alias(f"{f}_count"), F.min(f).alias(f"{f}_min"),
                 F.avg(f).alias(f"{f}_mean"), F.max(f).alias(f"{f}_max")]
    return labelled.groupBy(*SEGMENT_KEYS).agg(*aggs).orderBy(*SEGMENT_KEYS)


def active_players(labelled: DataFrame) -> DataFrame:
    """Distinct players with a completed level, per cluster and part of day."""
    return (labelled.where(F.col("numLevelsCompleted") > 0)
            .groupBy(*SEGMENT_KEYS, "partOfDay").agg(F.count_distinct("userId").alias("activePlayers")))


def avg_levels_completed(labelled: DataFrame) -> DataFrame:
    """Mean levels completed per cluster and part of day."""
    return (labelled.groupBy(*SEGMENT_KEYS, "partOfDay")
            .agg(F.avg("numLevelsCompleted").alias("avgLevelsCompleted")))


def avg_ads_watched(labelled: DataFrame) -> DataFrame:
    """Mean ads watched per cluster and part of day."""
    return labelled.groupBy(*SEGMENT_KEYS, "partOfDay").agg(F.avg("numAdsWatched").alias("avgAdsWatched"))


def organic_users(labelled: DataFrame) -> DataFrame:
    """Distinct players per cluster and organic label."""
    return (labelled.groupBy(*SEGMENT_KEYS, "flagOrganic").agg(F.count_distinct("userId").alias("numberOfUsers"))
            .select(*SEGMENT_KEYS, organic_label(F.col("flagOrganic")).alias("organic"), "numberOfUsers"))


def cluster_ids(labelled: DataFrame) -> DataFrame:
    """Distinct cluster ids, sorted."""
    return labelled.select(*SEGMENT_KEYS).distinct().orderBy(*SEGMENT_KEYS)


def cluster_sample(labelled: DataFrame, n: int = 20, order: tuple[str, ...] | None = None) -> DataFrame:
    """First ``n`` rows of each cluster in key order.

    ``row_number() <= n`` over a window lets Spark put a per-partition group limit
    before the shuffle, so each task sends at most ``n`` rows per cluster.
    """
    if order is None:
        period = "date" if "date" in labelled.columns else "codMonth"
        order = ("userId", period, "partOfDay")
    w = Window.partitionBy(*SEGMENT_KEYS).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return labelled.withColumn("rowInCluster", F.row_number().over(w)).where(F.col("rowInCluster") <= n)
