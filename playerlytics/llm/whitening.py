"""Whitening of embeddings: principal components of the distinct vectors, found by ``feast``.

Entries are taken as whole numbers floor(scale * c) + shift. Sums and products are of entries less
the rounded mean of their dimension, so that they are small whole numbers, which doubles hold
exactly. Tasks return sums over their rows (one matrix of dimension squared each), which are added
by group; only the added matrix, whose size depends on the dimension alone, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from . import feast
from .tables import stored

#: Larger |scale * c| count as this: whole numbers up to here are exact as doubles.
LARGEST = float(1 << 52)
_EXACT = 1 << 62


def whole_vectors(rows: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows whose vector has finite entries only, at least one."""
    usable = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = usable.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)

    def entry(c):
        return F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(shift).cast("long")

    return usable.select("vec_id", F.transform("v", entry).alias("x"))


def dimension(vectors: DataFrame) -> int:
    """The most frequent length (the largest of those that tie); 0 without vectors."""
    sizes = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    top = bounded_rows(sizes.orderBy(F.desc("n"), F.desc("d")).limit(1), 1)
    return top[0].d if top else 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _whole_sums(x: np.ndarray) -> list[int]:
    """Exact column sums as Python integers."""
    if int(np.abs(x).max(initial=0)) * len(x) < _EXACT:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(column) for column in x.T.tolist()]


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows of ``fit`` (column x) and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"dim": pa.array(np.arange(d, dtype=np.int32)),
                                       "n": pa.array([batch.num_rows] * d, pa.int64()),
                                       "s": pa.array([str(s) for s in _whole_sums(_matrix(batch.column("x"), d))])})

    parts = fit.select("x").mapInArrow(run, "dim int, n long, s string")
    rows = bounded_rows(parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), d)
    rows.sort(key=lambda r: r.dim)
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [0] * d)


def products(rows: DataFrame, d: int, values) -> np.ndarray:
    """The sum over all rows of the outer product of ``values`` (of a batch's matrix x) with itself."""
    width = len(values(np.zeros((1, d), np.int64))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                v = values(_matrix(batch.column("x"), d))
                total += v.T @ v
        yield pa.record_batch({"i": pa.array(np.arange(width, dtype=np.int32)),
                               "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select("x").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "p"))
    out = np.zeros((width, width))
    for r in bounded_rows(parts.groupBy("i", "j").agg(F.sum("p").alias("p")), width * width):
        out[r.i, r.j] = r.p
    return out


@dataclass
class Whitening:
    """The fitted model: its size depends on the dimension and the number of components alone."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # their unit vectors as columns
    explained: np.ndarray

    def __post_init__(self):
        self.centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)  # rounded means
        self.rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean."""
        return (x - self.centre) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; None where it passes a long."""
        z = x - self.centre
        most = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest))
        if most * most * len(self.sums) < _EXACT:
            return ((z * self.n - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        whole = [sum((self.n * c - r) ** 2 for c, r in zip(row, self.rest)) for row in z.tolist()]
        return [w if w < 1 << 63 else None for w in whole]


def fitted(fit: DataFrame, d: int, components: int) -> Whitening | None:
    """The components of the rows of ``fit`` (column x: distinct vectors of length ``d``; read twice). None without rows."""
    n, total = sums(fit, d)
    if not n:
        return None
    model = Whitening(n, total, np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    centre, rest = model.centre, np.array([r / n for r in model.rest])
    covariance = products(fit, d, lambda x: (x - centre).astype(float)) / n - np.outer(rest, rest)
    values, vectors = feast.largest(covariance, components)
    real = values > d * np.finfo(float).eps * (values[0] if len(values) else 0.0)
    model.values, model.vectors = values[real], vectors[:, real]
    model.explained = model.values / np.trace(covariance) if real.any() else model.values
    return model


def identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows of ``fit``, less the identity."""
    k = len(model.values)
    moments = products(fit, d, lambda x: np.column_stack([model.whitened(x), np.ones(len(x))])) / model.n
    covariance = moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k])
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold null or non-finite entries, or are not of the most frequent
    length (the largest, if several tie) take no part. Each distinct x vector is in the fit once;
    repeated rows and null ids are returned like any other. Entries beyond 2^52 / ``scale`` count
    as that. Components without variance (fewer distinct vectors than dimensions, say) are not
    returned, so equal vectors alone, a single one or an empty table give no rows. A deviation that passes
    a long is null. Eigenvalues that tie have some orthonormal basis of their space. Other columns
    are not read.
    """
    vectors = whole_vectors(rows, scale, shift, id_col, vector_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = dimension(vectors)
    vectors = vectors.where(F.size("x") == d)
    fit = stored(vectors.select("x").distinct(), "whitening-fit")
    model = fitted(fit, d, components) if d else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(fit, d, model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), model.n)), "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(model.whitened(x).ravel()), "explained": pa.array(np.tile(model.explained, len(x))),
                "identity_error": pa.array(np.full(len(each), error))})

    return vectors.mapInArrow(run, schema)
