"""Writers of the partitioned tables.

Every table is Parquet partitioned by its period columns. Before writing, rows are
rebalanced on the partition columns (the ``rebalance`` hint): AQE then groups each
partition value's rows into few tasks -- few files per directory -- and splits a
skewed value (a day holding a third of all rows) into several advisory-sized tasks
instead of one. ``overwrite="dynamic"`` replaces only the partitions present in the
data, so re-running one day or month leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..functions.bounded import bounded_rows
from ..session import remove_path

#: Partitions that a re-run may delete.
MOST_PARTITIONS = 1_000_000


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str], overwrite: str = "static",
                      rebalance: bool = True) -> None:
    """Overwrite ``path`` with ``df`` partitioned by ``partitions``.

    ``overwrite``: "static" replaces the whole table, "dynamic" only the partitions
    that ``df`` holds.
    """
    if overwrite not in ("static", "dynamic"):
        raise ValueError("overwrite must be 'static' or 'dynamic'")
    missing = [c for c in partitions if c not in df.columns]
    if missing:
        raise ValueError(f"partition columns not in the data: {missing}")
    out = df.hint("rebalance", *partitions) if rebalance and partitions else df
    (out.write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy(*partitions)
        .parquet(path))


def drop_stale_partitions(path: str, existing: DataFrame, rows: DataFrame, partitions: Sequence[str]) -> None:
    """Delete the partitions of ``existing`` (the table's rows of a period) of which ``rows`` has none.

    Both sides are lists of partition values: as many as a period has days and hours or parts of day.
    """
    spark = rows.sparkSession
    stale = existing.select(*partitions).distinct().exceptAll(rows.select(*partitions).distinct())
    for r in bounded_rows(stale, MOST_PARTITIONS):
        values = ["__HIVE_DEFAULT_PARTITION__" if v is None else v for v in r]
        remove_path(spark, "/".join([path.rstrip("/"), *(f"{c}={v}" for c, v in zip(partitions, values))]))
    spark.catalog.refreshByPath(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Save a fitted pipeline, replacing what is there."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
