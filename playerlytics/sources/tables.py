"""Reads of the written tables (S2, S3, S16) and the analysis inputs cut from them
(S6 raw player events, S7 rollup features, S8 cluster-labelled rows).

Every cut is a projection plus literal predicates on the partition column and
``gameId``, so Parquet scans prune partitions and push the game filter down.
``game_id=None`` keeps every game; the analysis operators group by ``gameId``, so
each game is still analysed on its own, in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import time as T
from .schemas import GRANULARITY_TABLE, RAW_TABLE, TABLE_SCHEMAS, cluster_schema
from .versions import Store


def table_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet read with a declared schema (S3); without one, with the stored schema of a table that has rows."""
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_published(spark: SparkSession, base: str, table: str, schema: StructType) -> DataFrame:
    """A table under ``base``: of the latest commit where ``base`` is a store (``versions``), else the plain folder."""
    store = Store(spark, base)
    return store.read(table, schema) if store.exists() else read_table(spark, table_path(base, table), schema)


def read_clusters(spark: SparkSession, path: str, granularity: str | None = None) -> DataFrame:
    """A segmentation's labelled rows; ``granularity`` declares their schema (needed where there may be no rows)."""
    return read_table(spark, path, cluster_schema(period_column(granularity)) if granularity else None)


def read_rollup(spark: SparkSession, base: str, granularity: str = "daily") -> DataFrame:
    """Daily or monthly rollup table under ``base``, read with its declared schema."""
    table, _, schema = GRANULARITY_TABLE[granularity]
    return read_published(spark, base, table, schema)


def read_raw_family(spark: SparkSession, base: str, family: str) -> DataFrame:
    """One cleaned family from the raw table (prunes the ``family`` partition)."""
    from ..operators.clean import family_rows
    return family_rows(read_published(spark, base, RAW_TABLE, TABLE_SCHEMAS[RAW_TABLE]), family)


def read_raw_players(spark: SparkSession, base: str) -> DataFrame:
    return read_raw_family(spark, base, "player")


def _period_filter(granularity: str, months: T.MonthRange | None):
    if months is None:
        return F.lit(True)
    if granularity == "daily":
        return months.date_filter(F.col("date"))
    return months.code_filter(F.col("codMonth"))


def _game_filter(game_id: str | None):
    return F.lit(True) if game_id is None else F.col("gameId") == F.lit(game_id)


def period_column(granularity: str) -> str:
    return GRANULARITY_TABLE[granularity][1]


def game_player_events(players_clean: DataFrame, game_id: str | None, months: T.MonthRange | None) -> DataFrame:
    """Raw (cleaned) player events of one game and month range."""
    return (players_clean.select("userId", "gameId", "attribution", "action", "date")
            .where(_game_filter(game_id) & _period_filter("daily", months)))


def segmentation_input(rollup: DataFrame, granularity: str = "daily", game_id: str | None = None,
                       months: T.MonthRange | None = None) -> DataFrame:
    """Feature rows of a rollup: five k-means features plus keys."""
    period = period_column(granularity)
    return rollup.select("userId", "gameId", "numLevelsStarted", "numLevelsCompleted", "numAdsWatched", "numPurchasesDone",
                         "partOfDay", T.part_of_day_number(F.col("partOfDay")).alias("partOfDayNumber"), "flagOrganic",
                         period).where(_game_filter(game_id) & _period_filter(granularity, months))


def cluster_input(labelled: DataFrame, granularity: str = "daily", game_id: str | None = None,
                  months: T.MonthRange | None = None) -> DataFrame:
    """Cluster-labelled rows of one game and range."""
    period = period_column(granularity)
    return labelled.select("userId", "gameId", "numLevelsCompleted", "numAdsWatched", "numPurchasesDone", "partOfDay",
                           T.part_of_day_number(F.col("partOfDay")).alias("partOfDayNumber"), "flagOrganic", "cluster",
                           period).where(_game_filter(game_id) & _period_filter(granularity, months))
