"""SentencePiece by suffix arrays: the library's ids and texts, and the parts against plain versions."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from playerlytics.llm import pieces

from .conftest import docs_df

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL, ENCODER = SentencePieceProcessor(model_file=PATH), pieces.Encoder(PATH)


def encoded(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    return [ids[i:e].tolist() for i, e in zip(bounds[:-1], bounds[1:])]


TEXT = st.text(st.one_of(st.sampled_from(" eantsrio,.é\n\t▁日本語ñ𝒳\x00"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_ids_are_the_librarys(texts):
    got = encoded(texts)
    assert got == MODEL.encode(texts)
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    assert ENCODER.decode(ids, bounds) == [MODEL.decode(x) if x else "" for x in got]
    assert ENCODER.decode(ids, bounds) == [t.replace("▁", " ") for t in texts]


def test_prose_blanks_and_long_units(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["the", "Reading", "international", "Straße", "naïve,", "x" * 90, "ab" * 400, "...", "9876", "", "", "日本語日本語", "e\nf"]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(20)] + ["", " ", "   ", "a ", " a", "  a   b  ", "z" * 5000, "é" * 300]
    want = MODEL.encode(texts)
    assert encoded(texts) == want
    monkeypatch.setattr(pieces, "INDEXED", 50)
    monkeypatch.setattr(pieces, "LONG_UNIT", 4)
    assert encoded(texts) == want
    assert encoded([]) == []


@settings(max_examples=80, deadline=None)
@given(st.text("ab▁c", min_size=1, max_size=40), st.integers(1, 9))
def test_suffix_array_sorts_prefixes(text, depth):
    order = pieces.suffix_array(pieces._codes(text), depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [text[i:i + depth] for i in order]
    assert cut == sorted(cut)


def test_operator_round_trip(spark):
    rows = [(1, "The quick  brown fox.\n"), (2, None), (3, ""), (None, "ünï"), (1, "The quick  brown fox.\n"), (4, "q" * 20_000)]
    got = pieces.encode(docs_df(spark, rows, "ids"), PATH, check=True)
    found = got.collect()
    by = dict(rows)
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    assert all(r.ids == (MODEL.encode(by[r.doc_id]) if by[r.doc_id] else []) for r in found)
    texts = sorted(((r.doc_id, r.text) for r in pieces.decode(got, PATH).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t in rows), key=str)
    odd = spark.createDataFrame([(1, None), (2, [None, 1, 2, -5, 99_999])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(odd, PATH).collect()} == {1: "", 2: " ⁇  ⁇ "[1:]}
    assert pieces.encode(docs_df(spark, []), PATH).count() == 0
