"""Language identification: every declared language takes part, whatever their number and size."""

import numpy as np

from playerlytics.llm import langid
from playerlytics.llm.tables import read

from .conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string"


def test_many_and_small_languages(spark):
    rng = np.random.default_rng(12)
    tags = [a + b for a in "abcd" for b in "klmnop"]  # 24
    letters = list("abcdefghijklmnopqrstuvwxyz")
    voices = {t: ["".join(rng.choice(letters, 5)) for _ in range(30)] for t in tags}
    sizes = {t: 40 - i if i < 20 else 3 for i, t in enumerate(tags)}
    sizes[tags[-1]] = 1
    rows = [(t, " ".join(rng.choice(voices[t], 40))) for t in tags for _ in range(sizes[t])]
    known = [(i, text, t, f"{t}.example.com") for i, (t, text) in enumerate(rows)]
    fresh = [(1000 + i, " ".join(rng.choice(voices[t], 40)), None, None) for i, t in enumerate(tags)]
    odd = [(2000, "zqxjvkq wqqzjj " * 40, "en-US", None), (2001, "123 456", "qq", None), (2002, None, "zz", None)]
    odd += [(2003, "".join(rng.choice(list("一二三四五六"), 200)), None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(known + fresh + odd, SCHEMA)).collect()}
    assert len(got) == len(known) + len(fresh) + len(odd)
    assert [(got[i].language, got[i].accepted) for i, *_ in known] == [(t, True) for _, _, t, _ in known]
    assert [(got[i].language, got[i].accepted) for i, *_ in fresh] == [(t, True) for t in tags]
    assert got[2000].language == "en" and not any(got[i].accepted for i in (2001, 2002, 2003))


def test_small_declared_language_of_the_table(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    spanish = [r.doc_id for r in docs.where("lang = 'es'").collect()]
    assert len(spanish) == 17 and all(got[i].language == "es" and got[i].accepted for i in spanish)


def test_one_declared_text_is_enough(spark):
    df = spark.createDataFrame([(1, "a few words that one text holds", "en", "h.org"), (2, "a few words", None, None), (3, None, None, None)], SCHEMA)
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify(df).collect()}
    assert got[1] == ("en", True) and got[3] == (None, False)
