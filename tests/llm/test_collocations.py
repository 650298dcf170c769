"""Collocations against brute force: counts, scores, ranks; the trie's bursts, spills, splits and runs; edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from playerlytics.llm import collocations as C

from .conftest import DOCS


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * a >= 100 * counts[p[i:i + k]]:
                        inside.add(p[i:i + k])
        found = []
        for p, a in cands.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    full = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).repartition(3)


def found(spark, rows, least, top=2000, **limits):
    return sorted(tuple(r) for r in C.collocations(table(spark, rows), least, top, **limits).toLocalIterator())


def some_rows(seed, n=120, vocabulary=25):
    rng = random.Random(seed)
    pool = [f"W{i}" for i in range(vocabulary)] + ["É", "é", "a\tb", "the the the", "of course it is so"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    texts = ["".join(w + rng.choice([" ", " ", "  ", ", ", "\n"]) for w in rng.choices(pool, weights, k=rng.randint(0, 60)))
             for _ in range(n)]
    return [(rng.choice(["en", "en", "fr", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("limits", [{}, {"held": 40, "burst": 5, "merge": 30, "parts": 2}, {"held": 200, "merge": 10, "parts": 1}])
def test_equals_brute_force(spark, limits):
    """With room to spare; with bursts, spills and splits at every turn."""
    rows = some_rows(1)
    want = brute(rows, 6)
    assert len(want) > 50 and found(spark, rows, 6, **limits) == want


def test_first_ranks_and_ties(spark):
    rows = some_rows(2) + [("en", "x y. x y. p q. p q.")] * 4
    assert found(spark, rows, 6, top=7) == brute(rows, 6, top=7)


def test_overlaps_pieces_and_marks(spark):
    rows = [("en", "no no no no no no. NO no\tno;no no\x0bno")] * 3 + [("en", "a.b a b,a b")] * 5
    assert found(spark, rows, 3) == brute(rows, 3)


def test_edge_rows(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [("en", None), ("en", ""), (None, " \t\n.")], 1) == []
    rows = [(None, "un deux"), ("und", "un deux"), ("", "un deux"), ("", "un deux"), ("en", "word " * 50_000)]
    assert found(spark, rows, 2) == brute(rows, 2)


def test_hot_pair_is_split(spark):
    """One pair of words begins most windows: its partition is dealt by what follows, the counts stay whole."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"of the w{rng.randint(0, 30)} v{rng.randint(0, 30)}" for _ in range(20))) for _ in range(60)]
    docs = table(spark, rows).select("lang", "text")
    counts, seed = C.counted_words(docs)
    runs = C.spilled_runs(docs, C.word_filter(counts), seed, parts=2).cache()
    cut = C.split_runs(runs, most=200)
    sizes = [r.e for r in cut.groupBy("lang", "part", "split").agg(F.sum("entries").alias("e")).toLocalIterator()]
    whole = runs.agg(F.sum("entries")).first()[0]
    assert sum(sizes) == whole and max(sizes) < 600 and len(sizes) > whole / 600
    assert found(spark, rows, 8, merge=200) == brute(rows, 8)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), min_size=5, max_size=5), min_size=1, max_size=200), st.integers(1, 8), st.integers(0, 60))
def test_trie_counts_and_spills(rows, burst, keep):
    rows = np.array(rows, np.uint64)
    trie, out = C.HatTrie(burst), Counter()
    for part in np.array_split(rows, 4):
        trie.add(part)
        windows, counts = trie.spill(keep)
        assert trie.entries() <= keep
        firsts = {w[0] for w in windows.tolist()}
        assert not firsts & {int.from_bytes(f, "big") for f in trie.root}  # subtrees go whole
        back, n = C.unpacked_run(C.packed_run(windows, counts)) if len(windows) else (windows, counts)
        assert back.tolist() == sorted(back.tolist())
        for w, c in zip(map(tuple, back.tolist()), n.tolist()):
            out[w] += c
    windows, counts = trie.spill(0)
    for w, c in zip(map(tuple, windows.tolist()), counts.tolist()):
        out[w] += c
    assert out == Counter(map(tuple, rows.tolist()))


def test_words_and_windows():
    codes, piece, distinct = C.words(pa.array(["A b\tÉ. c", "", "c\x0bb"]))
    assert [distinct[c].as_py().decode() for c in codes] == ["a", "b", "É", "c", "c", "b"]
    assert len(set(piece[:3].tolist())) == 1 and len(set(piece.tolist())) == 4
    w = C.windows(np.array([1, 2, 3, 0, 4, 5], np.uint64), np.array([0, 0, 0, 0, 0, 0]))
    assert w.tolist() == [[1, 2, 3, 0, 0], [2, 3, 0, 0, 0], [4, 5, 0, 0, 0]]


def test_rare_pairs_and_triples_make_no_runs(spark, monkeypatch):
    """Frequent words in rare pairs, and frequent pairs in rare triples, are not spilled; the counts stay whole."""
    rng, entries, stored = random.Random(8), {}, C.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "runs":
            entries[name] = out.agg(F.sum("entries")).first()[0]
        return out

    monkeypatch.setattr(C, "stored", counted)
    rows = [("en", " ".join(f"w{rng.randint(0, 300)}" for _ in range(30)) + ". p q r s") for _ in range(400)]
    rows += [("en", f"a b w{i}. w{i} a b") for i in range(300)]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert entries["runs"] < 100  # of 12,000 windows and more


def test_buckets_have_no_false_misses(spark):
    rows = some_rows(3)
    docs = table(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, seed = C.counted_words(docs)
    sent = C.sent_filter(docs, C.word_filter(counts))
    for k, least, parts, places in ((2, 6, 4, 50), (3, 4, 1, 10 ** 6)):
        have = {r.id: r.n for r in C.frequent_buckets(docs, sent, seed, [], k, 14, least, parts, places).toLocalIterator()}
        words_of = {(r.lang, r.word): r.id for r in counts.toLocalIterator()}
        want = Counter()
        for lang, text in rows:
            for w in pieces_of(text):
                ids = np.array([words_of["und" if lang is None else lang, x] for x in w], np.int64).view(np.uint64)
                for i in range(len(w) - k + 1):
                    want[int(C.bucket_ids(C.buckets(ids[None, i:i + k], 14)).view(np.int64)[0])] += 1
        assert have and have == {b: n for b, n in want.items() if n >= least}


def test_windows_end_at_rare_phrases():
    ids, piece = np.arange(1, 7, dtype=np.uint64), np.zeros(6, int)
    bits = np.full(1 << 10, 255, np.uint8)
    whole = C.windows(ids, piece)
    assert C.windows(ids, piece, [(2, 40, bits), (3, 40, bits)]).tolist() == whole.tolist()
    assert not len(C.windows(ids, piece, [(2, 40, bits * 0)]))
    assert C.windows(ids, piece, [(3, 40, bits * 0)]).tolist() == [[i, i + 1, 0, 0, 0] for i in range(1, 6)]
    assert C.windows(ids[:2], piece[:2], [(2, 40, bits), (3, 40, bits * 0)]).tolist() == [[1, 2, 0, 0, 0]]
    back, n = C.opened_buckets(C.packed_buckets(np.array([7, 3, 7, 70_000, 7], np.uint64)))
    assert back.tolist() == [3, 7, 70_000] and n.tolist() == [1, 3, 1]


def test_filter_has_no_false_misses(spark):
    ids = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63, 5000)
    bits = C.word_filter(spark.createDataFrame([(int(i),) for i in ids], "id long"))
    assert C.passes(ids.view(np.uint64), bits).all()
    assert C.passes(np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits).mean() < 0.05
    small = C.word_filter(spark.createDataFrame([(int(i),) for i in ids], "id long"), most_bits=1 << 15)
    assert len(small) == 1 << 12 and C.passes(ids.view(np.uint64), small).all()


def test_scores_past_64_bits(spark):
    a, n, left, right = 3 * 10 ** 15, 7 * 10 ** 16, 4 * 10 ** 15 + 1, 5 * 10 ** 15 + 3
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    score = row.select(C._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert score == 1000 * a * n // (left * right)
