"""Small results on the driver, with their bound checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from ..session import scratch_path

#: Rows that the driver holds between the steps of an iteration; larger states are written as tables.
SMALL_ROWS = 50_000


def bounded_rows(df: DataFrame, most: int) -> list[Row]:
    """All rows of ``df``, of which there are at most ``most``; more are an error, not cut off."""
    rows = [Row(**r) for r in df.limit(most + 1).toArrow().to_pylist()]
    if len(rows) > most:
        raise RuntimeError(f"more than the {most} rows that were to be expected at most")
    return rows


def small_or_stored(df: DataFrame, name: str, small: bool) -> DataFrame:
    """The rows of ``df``, computed once: held by the driver if ``small`` (then at most ``SMALL_ROWS``, which is checked),
    else a table in the shared folder."""
    spark = df.sparkSession
    if small:
        table = df.limit(SMALL_ROWS + 1).toArrow()
        if table.num_rows > SMALL_ROWS:
            raise RuntimeError(f"more than the {SMALL_ROWS} rows that were to be expected at most")
        return spark.createDataFrame(table, df.schema)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
