"""Bottom-k sketches: estimates against exact sets, merging, and the edited texts."""

import hashlib

import numpy as np
import pytest

from playerlytics.llm import edited, sketch

from .conftest import docs_df


def grams(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_small_texts_are_exact_and_equal_texts_have_equal_sketches(spark):
    rng = np.random.default_rng(0)
    words = ["a", "B", "c", "dé", "日本", "e."]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 90, 60)] + ["", None, " \n", "one", "ONE", "x " * 3000]
    rows = list(enumerate(texts)) + [(None, "one"), (3, texts[3])]
    got = [(r.doc_id, bytes(r.sketch)) for r in sketch.sketches(docs_df(spark, rows, "sketch")).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    sets = {i: grams(t or "") for i, t in rows}
    for i in sets:
        assert len(sketch.unpack(by[i])) == min(128, len(sets[i]))
    for i in range(0, 60, 5):
        for j in range(60):
            a, b = sketch.unpack(by[i]), sketch.unpack(by[j])
            if len(a) < 128 and len(b) < 128 and len(sets[i] | sets[j]) <= 128:
                assert sketch.resemblance(a, b, 128) == pytest.approx(jaccard(sets[i], sets[j]))
                if sets[i]:
                    assert sketch.containment(a, b, 128) == pytest.approx(len(sets[i] & sets[j]) / len(sets[i]))


def test_estimates_of_large_sets_and_merging(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 4000, 6000)]
    texts = [" ".join(base[:3000]), " ".join(base[1500:4500]), " ".join(base[3000:]), ""]
    by = {r.doc_id: sketch.unpack(r.sketch) for r in sketch.sketches(docs_df(spark, list(enumerate(texts))), k=512).collect()}
    sets = [grams(t) for t in texts]
    for i in range(3):
        assert abs(sketch.distinct(by[i], 512) / len(sets[i]) - 1) < 0.15
        for j in range(3):
            assert abs(sketch.resemblance(by[i], by[j], 512) - jaccard(sets[i], sets[j])) < 0.09
            assert abs(sketch.containment(by[i], by[j], 512) - len(sets[i] & sets[j]) / len(sets[i])) < 0.12
    parts = sketch.sketches(docs_df(spark, [(i % 2, t) for i, t in enumerate(texts)]), k=512)
    got = {r.doc_id: sketch.unpack(r.sketch) for r in sketch.merged(parts, "doc_id", 512).collect()}
    assert got[0].tolist() == sketch.bottom(np.concatenate([by[0], by[2]]), 512).tolist()
    assert got[1].tolist() == by[1].tolist()
    pairs = spark.createDataFrame([(bytearray(sketch.pack(by[0])), bytearray(sketch.pack(by[1])), 1), (None, None, 2)],
                                  "a binary, b binary, n int")
    found = {r.n: r for r in sketch.compared(pairs, k=512).collect()}
    assert found[1].resemblance == sketch.resemblance(by[0], by[1], 512) and found[2].resemblance == 1.0
    empty = sketch.merged(sketch.sketches(docs_df(spark, [(1, ""), (1, None)])), "doc_id").collect()
    assert [(r.doc_id, bytes(r.sketch)) for r in empty] == [(1, b"")]


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_edited_texts_and_successors(spark, parts):
    rng = np.random.default_rng(4)
    words = ["ab", "é日", "c", "𝒳y", "the"]
    texts = {int(i): " ".join(rng.choice(words, int(rng.integers(0, 60)))) for i in rng.choice(10_000, 70, replace=False)}
    rows = list(texts.items()) + [(20_000, None), (20_001, "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in edited.fingerprints_beside(docs_df(spark, rows, "lead"), with_text=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        want = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_text, r.edited_sha256) == (len(t), want, hashlib.sha256(want.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(grams(t), grams(want)))
        assert r.near_next == pytest.approx(jaccard(grams(t), grams(following)))


def test_edited_with_lone_empty_repeated_and_null_ids(spark):
    run = lambda rows: sorted(((r.doc_id, r.n_chars, r.edited_text) for r in
                               edited.fingerprints_beside(docs_df(spark, rows), with_text=True).collect()), key=str)
    assert run([]) == []
    assert run([(1, "abcd")]) == [(1, 4, "abab")]
    assert run([(5, "aaaa"), (5, "bbbb"), (None, "cccc"), (1, "dddd")]) == sorted(
        [(5, 4, "aabb"), (5, 4, "bbdd"), (1, 4, "ddcc"), (None, 4, "ccaa")], key=str)
