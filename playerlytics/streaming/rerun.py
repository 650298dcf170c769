"""Re-run the enrich job for the months that newly arrived events touch.

The batch job handles late data by re-running a day or month with dynamic partition
overwrite. Here Structured Streaming watches the raw-event folder: each micro-batch of
new files yields the months that it has events of, and the enrich job
(``plans.jobs.run_enrich``) re-runs for each of these, replacing only their partitions. The re-run is idempotent, so a batch that
Spark retries after a failure -- or replays after a restart from the checkpoint --
writes the same tables again.

Registration (first sign-up, organic flag) is computed from the whole player history
in each re-run, but only the touched months are rewritten: a late sign-up changes other
months' rows only when those months are re-run too (as with the batch job).
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import time as T
from ..functions.bounded import bounded_rows
from ..plans.jobs import run_enrich
from ..sources.events import read_events
from ..sources.schemas import EVENT_SCHEMA


# Months that a batch may touch: two centuries.
MOST_MONTHS = 2400
# Fixed value: the first month that an event can be of.
FIRST_MONTH = "200001"


def plausible_months() -> T.MonthRange:
    """From ``FIRST_MONTH`` through next month."""
    return T.MonthRange(FIRST_MONTH, T.month_code(date.today() + timedelta(days=31)))


def touched_months(batch: DataFrame, allowed: T.MonthRange | None = None) -> list[T.MonthRange]:
    """The months that the batch has events of, in order; timestamps outside ``allowed`` are none of them."""
    lo, hi = (allowed or plausible_months()).epoch_ms_bounds()
    in_range = (F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi))
    months = batch.where(in_range).select(T.cod_month(T.date_from_epoch_ms(F.col("timestamp"))).alias("m")).distinct()
    return [T.MonthRange.one(r.m) for r in bounded_rows(months.orderBy("m"), MOST_MONTHS)]


def enrich_on_arrival(spark: SparkSession, source: str, out: str, checkpoint: str, fmt: str = "parquet",
                      schema: StructType = EVENT_SCHEMA, granularity: str = "daily",
                      available_now: bool = True, processing_time: str | None = None,
                      allowed: T.MonthRange | None = None, **enrich_options) -> StreamingQuery:
    """Start a stream that re-enriches the months touched by each batch of new files.

    ``checkpoint`` is the folder that a restart resumes from. ``available_now=True`` processes
    what is there and stops (scheduled runs); otherwise it runs every ``processing_time``
    (e.g. "1 hour"). Events with timestamps outside ``allowed`` (default: 2000 through next
    month) re-run nothing. A month's re-run reads that month's behaviour events (its time range
    is pushed to the scan) and the players' events.
    """
    def rerun(batch: DataFrame, batch_id: int) -> None:
        for months in touched_months(batch, allowed):
            run_enrich(spark, read_events(spark, source, fmt, schema), out, months, granularity, **enrich_options)

    writer = (spark.readStream.format(fmt).schema(schema).load(source)
              .writeStream.foreachBatch(rerun).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
