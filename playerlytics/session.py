"""Session helpers: the shared scratch folder and a local session for tests and benches."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Read from the session. Only a local-mode session without one gets a fresh folder
    under the system temp dir; on a cluster a missing setting is an error, because a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="playerlytics-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch-{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems (nothing if it is not there)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A scratch path for the time of a job; its folder is deleted afterwards."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        remove_path(spark, path)


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "playerlytics") -> SparkSession:
    """A local session for tests and benches (UI off, AQE on, UTC)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               # let HotSpot JIT-compile large generated stage methods (wide CASE/aggregate
               # stages); on a cluster set the same in spark.executor.extraJavaOptions
               .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
               # no Python call-site capture per Column call (a debugging aid)
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
