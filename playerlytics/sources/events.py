"""Event sources: the raw collection (S1), player info (S4) and behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import time as T
from ..functions.predicates import is_behavior, is_family
from .schemas import BEHAVIOR_SCHEMA, EVENT_SCHEMA, PLAYER_INFO_SCHEMA


def read_events(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: StructType = EVENT_SCHEMA, options: dict | None = None) -> DataFrame:
    """Schema-projected read of an event collection in any Spark format.

    Fields missing from the files come back null, extra fields are dropped; with a
    columnar format only the declared columns are read.
    """
    reader = spark.read.format(fmt).schema(schema)
    if options:
        reader = reader.options(**options)
    return reader.load(path)


def project_schema(events: DataFrame, schema: StructType) -> DataFrame:
    """``events`` with exactly ``schema``'s columns (missing ones null, all cast)."""
    have = set(events.columns)
    return events.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in schema.fields])


def player_info_source(events: DataFrame) -> DataFrame:
    """Player-info events (attribution set) with their UTC ``date``.

    Not date-filtered: registration needs the player's whole history.
    """
    return (project_schema(events, PLAYER_INFO_SCHEMA)
            .where(is_family("player"))
            .withColumn("date", T.date_from_epoch_ms(F.col("timestamp"))))


def behavior_source(events: DataFrame, months: T.MonthRange | None = None,
                    on_bad_timezone: str = "error") -> DataFrame:
    """Level, ad and purchase events with a cleaned ``timezone``, a UTC ``datetime``
    (TIMESTAMP_NTZ) and ``date``, limited to ``months``.

    The month range is applied to the raw ``timestamp`` only: [first instant, first
    instant after) in epoch ms, which a columnar source pushes down to its scan (row
    groups and files outside the range are skipped). As ``date`` is the UTC day of
    ``timestamp``, this is exactly "date within the months".
    ``on_bad_timezone``: "error" (an unknown zone fails the job) or "utc" (treat it as UTC).
    """
    if on_bad_timezone not in ("error", "utc"):
        raise ValueError("on_bad_timezone must be 'error' or 'utc'")
    df = project_schema(events, BEHAVIOR_SCHEMA).where(is_behavior())
    if months is None:
        df = df.where(F.col("timestamp").isNotNull())
    else:
        lo, hi = months.epoch_ms_bounds()
        df = df.where((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi)))
    tz = T.clean_timezone(F.col("timezone"))
    if on_bad_timezone == "utc":
        tz = F.when(T.valid_timezone(tz), tz).otherwise(F.lit(T.DEFAULT_TIMEZONE))
    clock = T.utc_wall_clock(F.col("timestamp"))
    return df.withColumns({"timezone": tz, "datetime": clock, "date": T.date_of(clock)})
