"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playerlytics.llm import topk


def brute(rows, k, own):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if own(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 100, 8192])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # many equal rows: ties
    rows += [(2000, None), (2100, [0.1, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] + [0.0] * 7),
             (None, [0.5] * 8), (2400, [0.0] * 8), (2500, [3.0e4] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("block", F.lit(2))
    got = topk.search(df, F.col("vec_id") % 20 == 0, 10, block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, lambda i: i % 20 == 0)


def test_clustered_rows_stop_early_and_stay_exact():
    rng = np.random.default_rng(7)
    x = np.zeros((4000, 16), np.int64)
    x[np.arange(4000), rng.integers(0, 16, 4000)] = rng.integers(1, 1000, 4000)
    block = topk.Block(np.arange(4000), x)
    for _ in range(40):
        q = rng.integers(-300, 1000, 16) * (rng.random(16) < 0.4)
        ids, scores = block.search(-1, q, 10)
        full = x @ q
        want = np.lexsort((np.arange(4000), -full))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == full[want].tolist()


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    find = lambda rows: topk.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()
    assert find([]) == [] and find([(100, [1.0])]) == []
    assert [tuple(r) for r in find([(100, [1.0]), (3, [0.5, 9.0]), (3, [0.5, 9.0])])] == [(100, 1, 3, 1024 * 512), (100, 2, 3, 1024 * 512)]
