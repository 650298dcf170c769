"""The pipeline: each stage on its own and all of it against brute force."""


import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from playerlytics.llm import langid, pii, simhash
from playerlytics.llm.tables import read

from .conftest import SF, docs_df
from .test_packing import check_packs
from .test_pii import brute_terms
from .test_simhash import brute_classes, brute_fp


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(30)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(40)] + [(3, rows[3][1]), (3, rows[3][1])]
    rows += [(None, rows[4][1]), (None, "null one two three"), (None, "null one two three"), (500, None), (501, "")]
    docs = docs_df(spark, rows, "kept").withColumn("n", F.lit(7)).withColumn("row", F.lit("r"))
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    assert {(r.kept, r.n, r.row) for r in got.collect()} == {("x", 7, "r")}
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    distinct = sorted({(i, t) for i, t in rows if i is not None}, key=str)
    classes = brute_classes([(i, brute_fp(t)) for i, t in distinct])
    want = [(i, t) for i, t in distinct if classes[i] == i] + [(None, "null one two three")]
    assert found == sorted(want, key=str)
    assert simhash.deduplicated(docs_df(spark, [])).count() == 0


def test_repeated_ids_of_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "other words stand here now"), (2, "a b c d e f"), (None, "lone x y z"), (None, "sole q r s")]
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs_df(spark, rows)).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[4]], key=str)


def language_rows():
    rng = np.random.default_rng(8)
    voices = {"en": ["the", "and", "thing", "whether", "reading", "of"], "fr": ["le", "être", "français", "quoi", "des", "où"],
              "de": ["der", "und", "straße", "nicht", "schön", "ich"]}
    rows = [(i, " ".join(rng.choice(voices[v], 25)), v, f"{v}.example.{'de' if v == 'de' else 'com'}")
            for i, v in enumerate(rng.choice(list(voices), 240))]
    return rows, voices


def test_language_evidence_fuses(spark):
    rows, _ = language_rows()
    truth = {i: v for i, _, v, _ in rows}
    for i in range(0, 240, 12):  # wrong tags
        rows[i] = (*rows[i][:2], "fr", rows[i][3])
    odd = [(900, "%%% *** 123", "en", None), (901, None, "en", "en.example.com"), (902, "", None, None), (903, "ok", "de", "de.example.de"),
           (904, "zqxj vvkq wqqz jjxq kkzv " * 30, None, None), (None, rows[1][1], "EN-us", ""), (905, rows[1][1], "xx", "http://[bad")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows + odd + rows[:1], schema)
    got = [r for r in langid.identify(df).collect()]
    assert len(got) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    assert sum(by[i].language == v for i, v in truth.items()) >= 0.99 * len(truth)
    assert all(by[i].accepted for i in truth)
    assert not any(by[i].accepted for i in (900, 901, 902, 904)) and by[903].language == "de" and by[905].language == truth[1]
    kept = langid.identified(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.accepted)
    empty = spark.createDataFrame([], schema)
    assert langid.identify(empty).count() == 0 and langid.identified(empty).count() == 0


def test_declared_host_and_suffix_decide_short_texts(spark):
    rows, _ = language_rows()
    schema = "doc_id long, text string, lang string, source string"
    both = "xo"  # says little
    more = [(1000, both, "en", "http://en.example.com/x"), (1001, both, "de", "https://de.example.de/y"), (1002, both, None, "new.de"), (1003, both, None, "en.example.com")]
    by = {r.doc_id: r.language for r in langid.identify(spark.createDataFrame(rows + more, schema)).collect()}
    assert (by[1000], by[1001], by[1002], by[1003]) == ("en", "de", "de", "en")


def test_held_out_accuracy_and_pages(spark):
    docs = read(spark, SF.replace("0.001", "0.01"), "documents")
    held = docs.selectExpr("doc_id", "text", "lang AS truth", "if(doc_id % 3 = 0, NULL, lang) AS lang", "source")
    got = {r.doc_id: r for r in langid.identify(held).collect()}
    truth = {r.doc_id: r.truth for r in held.where("doc_id % 3 = 0").collect()}
    assert sum(got[i].language == t for i, t in truth.items()) >= 0.98 * len(truth)
    pages = langid.identify_pages(read(spark, SF, "pages")).collect()
    assert pages and sum(r.accepted for r in pages) >= 0.9 * len(pages)


@pytest.fixture(scope="module")
def brute(spark):
    """Documents after the first three stages, by plain Python (language ID: the operator's own verdicts)."""
    docs = read(spark, SF, "documents").collect()
    accepted = {r.doc_id for r in langid.identify(read(spark, SF, "documents")).collect() if r.accepted}
    rows = [(r.doc_id, r.text) for r in docs if r.doc_id in accepted]
    classes = brute_classes([(i, brute_fp(t)) for i, t in rows])
    rows = [(i, t) for i, t in rows if classes[i] == i]
    terms = {}
    for at, s, e in brute_terms([t for _, t in rows], 0.8):
        terms.setdefault(at, []).append(("term", s, e))
    out = {}
    for at, (i, t) in enumerate(rows):
        out[i] = pii.sanitised(t, pii.find(t) + terms.get(at, []))
    return out


def test_run_packs_what_brute_force_keeps(spark, brute):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in brute.items()}
    assert {r.doc_id for r in got} == set(ids)
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in ids.items()}
    import zlib
    for r in got:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    check_packs([(r.length, r.sequence_id, r.offset) for r in got], 2048)


def test_stages_return_the_columns_of_documents(spark):
    docs = docs_df(spark, [(1, "The one and the other thing."), (2, None), (None, "x@y.zz the"), (1, "The one and the other thing.")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
