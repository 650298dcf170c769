"""SimHash near-duplicates against a brute-force version, and the stated edge cases."""

import re

import numpy as np
import pytest
import xxhash

from playerlytics.llm import simhash
from playerlytics.llm.components import components

from .conftest import docs_df


def brute_fp(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps, bits=3):
    """fps: list of (doc_id, fp) -> {doc_id: smallest reachable}."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def test_fingerprint_and_classes_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], " ".join(rng.choice(words, 400))
    for i in range(60):
        t = base.split(" ")
        for _ in range(int(rng.integers(0, 6))):
            t[int(rng.integers(0, len(t)))] = "É　x"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(rng.choice(words, int(rng.integers(1, 30))))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one two"), (205, "ONE\x0btwo")]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_df(spark, rows, "fp")).collect()}
    fps = [(i, brute_fp(t)) for i, t in rows]
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(fps)
    assert {i: r.component_id for i, r in got.items()} == brute_classes(fps)
    assert got[201].component_id == got[202].component_id == 200


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 6])
def test_links_join_all_within_the_distance(spark, bits):
    rng = np.random.default_rng(bits)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(25):
            v = int(c)
            for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
                v ^= 1 << int(b)
            fps.add(v)
    rows = [(i, v) for i, v in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, int(np.uint64(v).view(np.int64))) for i, v in rows], "doc_id long, fp long")
    got = {r.fp & (2**64 - 1): r.component_id for r in simhash.classes(df, bits).collect()}
    want = brute_classes(rows, bits)
    assert got == {v: want[i] for i, v in rows}


def test_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(docs_df(spark, [])).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words here now ok")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs_df(spark, rows)).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
