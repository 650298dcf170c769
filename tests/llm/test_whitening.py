"""Whitening and its eigenpairs against numpy's dense solver and Python integers; edge rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playerlytics.llm import feast, whitening

from .conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


SPECTRA = {
    "spread": np.linspace(1, 100, 40),
    "geometric": 2.0 ** -np.arange(30),
    "ties at the cut": np.array([9.0] * 10 + [5.0] * 12 + [1.0] * 10),
    "one value": np.full(25, 3.0),
    "near ties": 1 + np.arange(30) * 1e-9,
    "rank deficient": np.concatenate([np.zeros(20), np.arange(1, 6)]),
    "negative": np.linspace(-5, 5, 31),
    "tiny": np.linspace(1, 2, 20) * 1e-200,
    "two": np.array([1.0, 2.0]),
    "one": np.array([4.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_largest_pairs(name):
    values = np.sort(SPECTRA[name])[::-1]
    matrix = symmetric(values)
    found, vectors = feast.largest(matrix, 16)
    k, scale = min(16, len(values)), np.abs(values).max()
    assert found.shape == (k,) and np.abs(found - values[:k]).max() <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-6
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-11 * scale


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10_000))
def test_counts_and_pairs_of_any_matrix(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (n, n)).astype(float)
    a = a + a.T
    want = np.linalg.eigvalsh(a)
    diagonal, off = feast.tridiagonal(a)
    shifts = np.concatenate([want - 1e-6, want + 1e-6])
    assert feast.below(diagonal, off, shifts).tolist() == [int((want < s).sum()) for s in shifts]
    found, vectors = feast.largest(a, 5)
    assert np.allclose(found, want[::-1][:5], atol=1e-9)
    assert np.allclose(a @ vectors, vectors * found, atol=1e-8)


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.interval_pairs(symmetric(np.linspace(1, 10, 10)), 4.5, 7.5, 2)


def brute(rows, components, scale=64, shift=1_000_000):
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(scale * float(np.float32(c))) + shift for c in v)) for i, v in usable]
    fit = sorted({v for _, v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, total)] for v in fit])
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(v, total)),
            (np.array([c - s / n for c, s in zip(v, total)]) @ u) / np.sqrt(e)) for i, v in x]
    return n, out, e / np.trace(covariance)


def check(spark, df, rows, components=16):
    found = [tuple(r) for r in whitening.whiten(df, components).toLocalIterator()]
    n, want, explained = brute(rows, components)
    k = len(explained)
    assert len(found) == len(want) * k
    values = {}
    for i, c, m, deviation, value, share, error in found:
        assert m == n and abs(share / explained[c - 1] - 1) < 1e-9 and error < 1e-9
        values.setdefault((str(i), deviation), {}).setdefault(c, []).append(value)
    assert {key for key in values} == {(str(i), d) for i, d, _ in want}
    signs = {}
    for i, deviation, w in want:
        for c in range(k):
            got = values[(str(i), deviation)][c + 1][0]
            if abs(w[c]) > 1e-3:
                assert signs.setdefault(c, np.sign(got * w[c])) == np.sign(got * w[c])
            assert abs(abs(got) - abs(w[c])) < 1e-7 * max(1, abs(w[c]))


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.toLocalIterator()]
    check(spark, df, rows)


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.5, 5)]) for i in range(60)]
    rows += [(1, rows[1][1]), (None, rows[2][1]), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0]), (72, [float("nan")] * 5),
             (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    check(spark, df, rows)
    ragged = df.union(spark.createDataFrame([(99, [1.0, 2.0], 0)], VECTORS).withColumn("x", F.lit("c")).withColumn("n", F.lit(1)))
    check(spark, ragged, rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [0.5, 0.25], 0)], [(1, [0.5, 0.25], 0)] * 3, [(1, None, 0)], [(1, [], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_fewer_vectors_than_dimensions(spark):
    rows = [(i, [float(i == j) for j in range(6)], 0) for i in range(3)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert sorted(set(found.component)) == [1, 2] and (found.identity_error < 1e-9).all()


def test_large_entries_stay_exact(spark):
    big = [(i, [float(2.0 ** (30 + i % 5)), float(i), 3e38 if i == 0 else 1.0], 0) for i in range(12)]
    found = whitening.whiten(spark.createDataFrame(big, VECTORS)).toPandas()
    assert found.deviation.isna().any() and np.isfinite(found.whitened).all()
    small = [(i, [float(2.0 ** 10 * (i % 5)), float(i)]) for i in range(12)]
    check(spark, spark.createDataFrame([(i, v, 0) for i, v in small], VECTORS), small)
