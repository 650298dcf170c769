"""Tables published together: versioned partition folders and a manifest that is swapped in one step.

A ``Store`` is a folder of tables. A run writes its rows into version folders of its own
(``<table>/v=<version>/<partition>``), which no reader sees yet. A manifest, itself a small Parquet table,
lists the live (table, partition, version) rows; the file ``_commits/<number>`` that names it, put in
place by one rename that never replaces a file, makes all the run's tables visible at once. Readers resolve the latest commit, so
a run that stops half way, or is still under way, leaves every table as it was. Older
commits stay readable until ``vacuum`` removes what no kept commit names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.bounded import bounded_rows
from ..session import remove_path

#: Partitions of one table that a reader lists, and commits that a store keeps.
MOST_PARTITIONS, MOST_COMMITS = 1_000_000, 100_000
MANIFEST_SCHEMA = "table string, part string, version string"
_VERSION = "v"
#: Rows of a file are ordered by game and player, so that statistics of its row groups let reads skip them.
PLAYER_SORT = ("gameId", "userId")


def player_filters(players: int = 100_000) -> dict[str, str]:
    """Writer options: Bloom filters on userId for about as many players in a file, so that a read of one skips row groups."""
    return {"parquet.bloom.filter.enabled#userId": "true", "parquet.bloom.filter.expected.ndv#userId": str(players)}


def month_of_part() -> Column:
    """The month (yyyyMM) of a partition folder that begins with a date or a month."""
    part = F.col("part")
    return F.when(part.startswith("codMonth="), F.substring(part, 10, 6)).otherwise(F.concat(F.substring(part, 6, 4), F.substring(part, 11, 2)))


class ConcurrentCommit(RuntimeError):
    """Another run committed first: this one's tables were computed from an older state."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def partition_path(columns: Sequence[str]) -> Column:
    """The folder of a row's partition, as Spark names it (dates, numbers and plain words)."""
    def one(c: str) -> Column:
        text = F.col(c).cast("string")
        plain = F.when(text.rlike("^[A-Za-z0-9_.+-]+$"), text).otherwise(F.raise_error(F.concat(F.lit(f"{c} cannot name a folder: "), text)))
        return F.concat(F.lit(f"{c}="), F.when(F.col(c).isNull(), F.lit("__HIVE_DEFAULT_PARTITION__")).otherwise(plain))
    return F.concat_ws("/", *[one(c) for c in columns])


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def commits(self) -> list[int]:
        """Numbers of the commits that can be read, in order."""
        return [int(n) for n in _names(self.spark, f"{self.base}/_commits") if n.isdigit()]

    def exists(self) -> bool:
        return bool(self.commits())

    def manifest(self, commit: int | None = None) -> DataFrame:
        """Live (table, part, version) rows of a commit (the latest one)."""
        found = self.commits()
        at = commit if commit is not None else (found[-1] if found else 0)
        if not at:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.base}/_manifest/{self._named(at)}")

    def _named(self, commit: int) -> str:
        """The manifest that a commit names."""
        where, fs = _fs(self.spark, f"{self.base}/_commits/{commit:09d}")
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def partitions(self, table: str, commit: int | None = None) -> DataFrame:
        return self.manifest(commit).where(F.col("table") == table).select("part", "version")

    def read(self, table: str, schema: StructType, commit: int | None = None, parts: Column | None = None) -> DataFrame:
        """The table as of a commit; ``parts`` is a condition on the partition folder (column part) that limits what is listed."""
        live = self.partitions(table, commit)
        rows = bounded_rows(live if parts is None else live.where(parts), MOST_PARTITIONS)
        if not rows:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.base}/{table}/{_VERSION}={r.version}/{r.part}".rstrip("/") for r in rows]
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/{table}").parquet(*sorted(paths)).select(*schema.names)

    def begin(self) -> Run:
        return Run(self)

    def vacuum(self, keep: int = 1) -> None:
        """Remove commits older than the latest ``keep``, and the folders that only they name. Not while a run is under way."""
        found = self.commits()
        old, kept = found[:-keep] if keep else found, found[-keep:] if keep else []
        live = reduce(DataFrame.unionByName, [self.manifest(c) for c in kept], self.spark.createDataFrame([], MANIFEST_SCHEMA))
        versions = {(r.table, r.version) for r in bounded_rows(live.select("table", "version").distinct(), MOST_PARTITIONS)}
        manifests = {self._named(c) for c in kept}
        for c in old:
            remove_path(self.spark, f"{self.base}/_commits/{c:09d}")
        for n in _names(self.spark, f"{self.base}/_manifest"):
            if n not in manifests:
                remove_path(self.spark, f"{self.base}/_manifest/{n}")
        for table in _names(self.spark, self.base):
            if not table.startswith("_"):
                for folder in _names(self.spark, f"{self.base}/{table}"):
                    if (table, folder.removeprefix(f"{_VERSION}=")) not in versions:
                        remove_path(self.spark, f"{self.base}/{table}/{folder}")


class Run:
    """One run's new versions of tables; nothing is visible before ``commit``."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        found = store.commits()
        self.parent, self.version = (found[-1] if found else 0), uuid.uuid4().hex
        self.added: list[DataFrame] = []
        self.gone: list[tuple[str, Column | DataFrame]] = []

    def _write(self, table: str, rows: DataFrame, columns: Sequence[str], options: dict[str, str],
               sort: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """The new (table, part, version) rows, and the rows as they are read from their folder."""
        version = uuid.uuid4().hex  # a folder of its own for each write
        path = f"{self.store.base}/{table}/{_VERSION}={version}"
        out = rows.hint("rebalance", *columns) if columns else rows
        if sort:
            out = out.sortWithinPartitions(*columns, *sort)
        writer = out.write.options(**options)
        (writer.partitionBy(*columns) if columns else writer).parquet(path)
        written = self.spark.read.schema(rows.schema).option("basePath", path).parquet(path)
        part = partition_path(columns) if columns else F.lit("")
        new = written.select(F.lit(table).alias("table"), part.alias("part"), F.lit(version).alias("version")).distinct()
        self.added.append(new)
        return new, written.select(*rows.columns)

    def replace(self, table: str, rows: DataFrame, columns: Sequence[str], scope: Column | None = None,
                options: dict[str, str] | None = None, sort: Sequence[str] = ()) -> DataFrame:
        """The partitions that ``scope`` (a condition on column part; None: all) names become those of ``rows``.

        Partitions in the scope that ``rows`` lacks vanish; rows must not have partitions outside it. ``sort`` orders
        the rows of each file, so that statistics and Bloom filters of its row groups let reads skip them. Returns the
        rows as they are read from their folder, so that what builds on them needs no second copy.
        """
        self.gone.append((table, F.lit(True) if scope is None else scope))
        return self._write(table, rows, columns, options or {}, sort)[1]

    def replace_present(self, table: str, rows: DataFrame, columns: Sequence[str], options: dict[str, str] | None = None,
                        sort: Sequence[str] = ()) -> None:
        """Only the partitions that ``rows`` has become those of ``rows``."""
        self.gone.append((table, self._write(table, rows, columns, options or {}, sort)[0].select("table", "part")))

    def append(self, table: str, rows: DataFrame, columns: Sequence[str] = (), options: dict[str, str] | None = None,
               sort: Sequence[str] = ()) -> None:
        """``rows`` beside what the table holds."""
        self._write(table, rows, columns, options or {}, sort)

    def commit(self) -> int:
        """Make all of the run's tables visible in one step; the number of the commit."""
        held = self.store.manifest(self.parent)
        for table, scope in self.gone:
            if isinstance(scope, DataFrame):
                held = held.join(scope, ["table", "part"], "left_anti").select(*held.columns)
            else:
                held = held.where(~((F.col("table") == table) & scope))
        number = self.parent + 1
        reduce(DataFrame.unionByName, self.added, held).coalesce(1).write.parquet(f"{self.store.base}/_manifest/{self.version}")
        draft, fs = _fs(self.spark, f"{self.store.base}/_drafts/{self.version}")
        out = fs.create(draft, False)
        out.writeBytes(self.version)
        out.close()
        commits, _ = _fs(self.spark, f"{self.store.base}/_commits")
        fs.mkdirs(commits)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_replace = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        never_replace[0] = getattr(hadoop, "Options$Rename").NONE
        files = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(hadoop.Path(commits, f"{number:09d}")), never_replace)
        except Exception as e:
            raise ConcurrentCommit(f"commit {number} is there already") from e
        return number
