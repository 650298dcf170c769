"""Reading the input tables, and small helpers that every operator of the subpackage uses."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playerlytics.session import checkpoint_dir, scratch_path

#: Bytes of text that one step of a Python task works on; bounds its memory whatever the batch holds.
STEP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver does (a folder of their own nodes, or a shared one).

    Packages shipped with ``--py-files`` or installed on the nodes are found without it.
    """
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment
    paths = [p for p in held.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        held["PYTHONPATH"] = os.pathsep.join([*paths, root])


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder: cuts lineage and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back with its schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on through the stages of an executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    release_memory()
    sizes = np.array(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release_memory()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and each row's byte offsets (one more than rows)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def run_bounds(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length of the array at the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length) pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The stretches (start, length) of ``values``, one after the other; about ``step`` at a time, to keep indices small."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    i = at = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, at + step, side="right")))
        out[at:ends[j - 1]] = values[ragged_take(starts[i:j], lengths[i:j])]
        i, at = j, int(ends[j - 1])
    return out
