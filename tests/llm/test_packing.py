"""Packing: ids against the tokenizer, every id in one piece, gapless offsets, little padding."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from playerlytics.llm import packing

from .conftest import docs_df

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packs(rows, size):
    """Rows: (length, sequence_id, offset); returns the padding."""
    by = {}
    for length, seq, offset in rows:
        by.setdefault(seq, []).append((offset, length))
    used = []
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
        used.append(at)
    return sum(size - u for u in used if u & (u - 1))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_patterns_hold_the_histogram(histogram):
    found = packing.patterns(histogram, 64)
    assert all(sum(lengths) <= 64 and n > 0 for n, lengths in found)
    held = Counter()
    for n, lengths in found:
        for x in lengths:
            held[x] += n
    assert held == Counter(histogram)
    at = packing.places(found)
    assert len(at["length"]) == sum(len(x) for _, x in found)


def test_pieces_are_the_tokenizers_ids(spark):
    tok = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    words = ["The", "été", "don't", "x's", "12345", "<|endoftext|>", "a\tb\nc", "…—", "éa", "Ⅳ日本", " q r", ""]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 900))))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " "), (53, "z" * 30_000), (7, rows[7][1]), (None, "a b"), (54, " ́x  ý")]
    got = packing.pack(docs_df(spark, rows, "length"), PATH, 256, 1, with_ids=True).collect()
    texts = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        texts[(i, tuple(ids))] += 1
    rebuilt = Counter()
    by_doc = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 256
        by_doc.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(tuple(r.ids))
    for (i, n), parts in by_doc.items():
        at, flat = 0, ()
        copies = {len(x) for x in parts.values()}
        assert len(copies) == 1
        for start in sorted(parts):
            assert start == at and len(set(parts[start])) == 1
            flat += parts[start][0]
            at = len(flat)
        assert at == n
        rebuilt[(i, flat)] += copies.pop()
    assert rebuilt == texts
    check_packs([(r.length, r.sequence_id, r.offset) for r in got], 256)


@pytest.mark.parametrize("part_rows", [7, 20_000])
def test_places_are_gapless_with_split_bins(spark, monkeypatch, part_rows):
    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 65, 400), np.full(300, 64), np.full(200, 5)])
    cut = spark.createDataFrame([(i, 0, int(n), i, int(n)) for i, n in enumerate(lengths)],
                                "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.assign(cut, 64).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(lengths)))
    padding = check_packs([(r.length, r.sequence_id, r.offset) for r in got], 64)
    assert padding < 0.02 * lengths.sum()


def test_empty_table(spark):
    assert packing.pack(docs_df(spark, []), PATH).count() == 0


def test_case_and_marks_share_words(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["Word word, WORD! It's IT'S, A\u030a. a\u030a İ. 7. ٣, x_! \u0301, b\u0301.", "one\ntwo.\n\n Three", "Ⅳ. ⅳ, K, ſ!"]
    memo = packing.tokenizer(PATH)
    import pyarrow as pa
    for group in ([t] for t in texts), (texts,):
        for part in group:
            ids, bounds = packing.token_ids(pa.array(part), memo, 1)
            for t, i, e in zip(part, bounds[:-1], bounds[1:]):
                assert ids[i:e].tolist() == tok.encode(t, add_special_tokens=False).ids + [1]


def test_composed_upper_case_and_special_tokens_are_the_tokenizers_ids():
    import pyarrow as pa
    tok = Tokenizer.from_file(PATH)
    marks = ["̱", "̌", "̈", "̊", "́", "̣"]
    texts = [" ".join(f"{c}{m}allo {c}{m}." for m in marks) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    texts += ["H̱allo WORLD, Plain", "The <|endoftext|> END <|ENDOFTEXT|> x<|endoftext|>Y.", "PLAIN Words\nHERE."]
    memo = packing.tokenizer(PATH)
    for group in ([[t] for t in texts], [texts], [texts[::-1]]):
        for part in group:
            ids, bounds = packing.token_ids(pa.array(part), memo, 1)
            for t, i, e in zip(part, bounds[:-1], bounds[1:]):
                assert ids[i:e].tolist() == tok.encode(t, add_special_tokens=False).ids + [1]


def test_forgotten_words_give_the_same_ids(monkeypatch):
    """A memo that holds few words turns its generations over all the time; one memo serves all tasks of a process."""
    import pyarrow as pa

    from playerlytics.llm import chunks
    monkeypatch.setattr(chunks, "MEMO_WORDS", 12)
    tok = Tokenizer.from_file(PATH)
    memo = chunks.Memo(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(40)] + ["the"] * 20 + ["x" * 60, ""]
    for _ in range(30):
        text = " ".join(rng.choice(vocabulary, 25))
        ids, _ = packing.token_ids(pa.array([text]), memo, 1)
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids + [1]
        assert len(memo.young) <= 6 + 26 + 1 and len(memo.old) <= 6 + 26 + 1
    assert packing.tokenizer(PATH) is packing.tokenizer(PATH)
