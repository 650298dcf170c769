"""Dropping lines that many documents share, by levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of
at least ``least_chars`` code points in at least ``least_docs`` documents lose all their lines,
except in the document of the largest id that holds them. Everything is DataFrame functions.

Keys are 128-bit hashes. Documents come in batches of descending id. A run holds, per key, the
number of documents and the largest id, as a table bucketed and sorted by the key, so that a batch is
merge-joined with a run, and runs with one another, without a shuffle of the runs. A batch is
anti-joined with the runs: keys that a run has settled (enough documents, an id at least as large)
are known, the others are added as a run of their own. ``fanout`` runs of a level are compacted
into one of the next level, so that each key is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows
from playerlytics.session import remove_path, scratch_path

from .tables import stored, text_or_empty

_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h", "g"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row per line with a long enough key: id, text_hash, h, g, at (from 0), first (of its key in the row).

    ``docs`` has the columns id and text. The keys are sorted within the row, so that alike ones
    stand together: the number of documents of a key is the sum of ``first``.
    """
    keys = F.transform(split_lines(F.col("text")), line_key)
    hashes = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"),
                                                     i.alias("at"), (F.char_length(k) >= least_chars).alias("long")))
    rows = docs.select("id", F.xxhash64("text").alias("text_hash"),
                       F.sort_array(F.filter(hashes, lambda x: x["long"])).alias("found"))

    def marked(x: Column, j: Column) -> Column:
        before = F.get("found", j - 1)
        return F.struct(x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("at"),
                        (before.isNull() | (before["h"] != x["h"]) | (before["g"] != x["g"])).alias("first"))

    return rows.select("id", "text_hash", F.inline(F.transform("found", marked)))


class LineRuns:
    """Runs of (h, g, docs, top) in levels; ``add`` in any order of batches, each document in one batch only.

    The runs are the partitions of one bucketed table: a scan of several runs reads a bucket of all of them
    in one task, so that they merge with each other, and with a batch, without a shuffle of the runs.
    """

    def __init__(self, spark: SparkSession, least_docs: int, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.least_docs, self.fanout = spark, least_docs, fanout
        # as many buckets as shuffle partitions: a batch's aggregation deals its rows just as the runs are
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.name = scratch_path(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[int]] = [[]]
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        (rows.withColumn("run", F.lit(self.made)).write.format("parquet").mode("append").option("path", self.path)
         .partitionBy("run").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(self.name))
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self.made)
        self.made += 1

    def table(self, runs: list[int]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs)).drop("run")

    def runs(self) -> list[int]:
        return [run for level in self.levels for run in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (h, g, docs, top) whose key no run has settled with as large an id."""
        if not self.runs():
            return batch
        known = (self.table(self.runs()).where(F.col("docs") >= self.least_docs)
                 .select(F.col("h").alias("_h"), F.col("g").alias("_g"), F.col("top").alias("_top")).hint("merge"))
        held = F.col("top").isNull() | (F.col("_top") >= F.col("top"))
        return batch.join(known, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & held, "left_anti")

    def add(self, lines: DataFrame) -> None:
        """Add a batch of ``keyed_lines``."""
        own = lines.groupBy(*KEY).agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("id").alias("top"))
        self._write(self.unsettled(own), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.compacted(full), level + 1)
            for run in full:  # no read names it any more
                remove_path(self.spark, f"{self.path}/run={run}")
            level += 1

    def compacted(self, runs: list[int]) -> DataFrame:
        return self.table(runs).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def repeated(self) -> DataFrame:
        """h, g and the largest id of every key of ``least_docs`` documents or more (null: only null ids)."""
        return self.compacted(self.runs()).where(F.col("docs") >= self.least_docs).select(*KEY, "top")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


@contextmanager
def line_runs(spark: SparkSession, least_docs: int, fanout: int = 4) -> Iterator[LineRuns]:
    """Runs for the time of a job; their tables and files are removed afterwards."""
    runs = LineRuns(spark, least_docs, fanout)
    try:
        yield runs
    finally:
        runs.close()


def batch_number(docs: DataFrame, batches: int) -> Column:
    """Batches of about as many documents each, the largest ids first; null ids are in the last one."""
    shares = [i / batches for i in range(1, batches)]
    bounds = bounded_rows(docs.agg(F.percentile_approx("id", shares).alias("at")), 1)[0].at if shares else []
    return sum((F.coalesce(F.col("id") <= F.lit(b), F.lit(True)).cast("int") for b in bounds or []), F.lit(0))


def dropped_lines(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """id, text_hash and the places (from 0) of all lines to drop, of documents that have such lines."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    lines = keyed_lines(docs, least_chars).withColumn("batch", batch_number(docs, batches))
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    with line_runs(spark, least_docs, fanout) as runs:
        for batch in range(batches):
            runs.add(lines.where(F.col("batch") == batch))
        repeated = stored(runs.repeated(), "repeated-lines")
    gone = lines.join(repeated, KEY).where(F.col("id").isNull() & F.col("top").isNotNull() | (F.col("id") < F.col("top")))
    return stored(gone.groupBy("id", "text_hash").agg(F.collect_set("at").alias("places")), "dropped-lines")


def without_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 8, fanout: int = 4,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without its repeated lines: doc_id, text, n_lines (before), n_dropped.

    Null and empty texts are one empty line. Each row is a document: repeated rows count as
    several, and rows that tie for the largest id all keep their lines. Null ids come before all others;
    a key that only null ids hold stays. An empty table gives no rows; other columns are not read.
    Ids are numbers.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    gone = dropped_lines(rows, least_chars, least_docs, batches, fanout).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "places")
    found = (rows.withColumn("text_hash", F.xxhash64("text"))
             .join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
             .select("id", "text", "places", split_lines(F.col("text")).alias("lines")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    n = F.size("lines").cast("long")
    return (found.withColumn("kept", F.when(F.col("places").isNotNull(), kept))
            .select(F.col("id").alias("doc_id"), F.when(F.col("kept").isNull(), F.col("text")).otherwise(text).alias("text"),
                    n.alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).alias("n_dropped")))
