"""Personal data: base kinds against the plain patterns, disclosures against brute force, sanitised texts."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from playerlytics.llm import pii, spans

from .conftest import docs_df


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for i, (kind, pat, ok) in enumerate((
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15))):
        out += [(m.start(), i, m.end(), kind) for m in re.finditer(pat, text) if ok(m)]
    return [(k, s, e) for s, _, e, k in sorted(out)]


PARTS = st.sampled_from(["a", "b.c", "@", "x@y", ".", "..", "-", "1", "25", "255", "256", "007", "4111111111111111", " ", "+", "+1",
                         "(", ")", "555-1234", "٣", "é", "𝒳", "%", "@h.com", "1.2.3.4", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=20))
def test_base_kinds_are_the_patterns(parts):
    text = "".join(parts)
    got = spans.in_order(pii.find(text), pii.KINDS)
    assert [(s["kind"], s["start"], s["end"]) for s in got] == brute(text)


WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def low(w):
    return "".join(c.lower() if c.isascii() else c for c in w)


def brute_terms(rows, threshold=0.8):
    """rows: texts -> set of (row, start, end) of disclosing terms, scored over whole documents."""
    df, held = {}, []
    for t in rows:
        for w in {low(m[0]) for m in WORD.finditer(t)}:
            df[w] = df.get(w, 0) + 1
        base = brute(t)
        free = [m for m in WORD.finditer(t) if not any(m.start() < e and s < m.end() for _, s, e in base)]
        held.append(({pii._entity(k, t[s:e]) for k, s, e in base}, tuple(low(m[0]) for m in free), free))
    n, documents = len(rows), {}
    for entities, words, _ in held:
        for e in entities:
            documents.setdefault(e, set()).add(words)
    out = set()
    for i, (entities, words, free) in enumerate(held):
        for e in entities:
            n_e = len(documents[e])
            if n_e < n:
                gone = {w for w in set(words) if math.log2(sum(w in d for d in documents[e]) / n_e * n / df[w])
                        >= threshold * math.log2(n / n_e) - 1e-9}
                out |= {(i, m.start(), m.end()) for m in free if low(m[0]) in gone}
    return out


def corpus():
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i)}é" for i in range(20)]
    texts = []
    for i in range(60):
        body = list(rng.choice(words, 30))
        if i % 3 == 0:
            body[10:10] = ["Jane", "Example", "mail", "jane.x@mail.example.com", "Dept", "nr77"]
        if i % 5 == 0:
            body[4:4] = ["call", "+1", "(555)", "123-4567"]
        texts.append(" ".join(body))
    return texts + texts[:10] + ["", "1.2.3.4", "x" * 2_000 + "@", "1" * 2_000]


def test_disclosing_terms_match_brute_force(spark):
    texts = corpus()
    got = pii.scan_personal_data(docs_df(spark, list(enumerate(texts)), "spans")).collect()
    assert len(got) == len(texts)
    terms = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == "term"}
    assert terms == brute_terms(texts) and terms
    words = {texts[i][s:e] for i, s, e in terms}
    assert {"Jane", "Example"} <= words
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind != "term"] == brute(texts[r.doc_id])


def test_sanitise_keeps_rows_and_columns(spark):
    texts = corpus()
    rows = [*enumerate(texts), (None, None), (3, texts[3])]
    docs = docs_df(spark, rows, "row")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[None].text is None and by[1].text == texts[1] and by[1].row == "x"
    assert "<EMAIL>" in by[3].text and "jane" not in by[3].text.lower() and by[3].n_chars == len(by[3].text)
    assert not any(pii.find(r.text) for r in found if r.text)


def test_empty_table(spark):
    assert pii.scan_personal_data(docs_df(spark, [])).count() == 0
    assert pii.sanitise(docs_df(spark, [])).count() == 0


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000, "x" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000, "a@b" * 100_000):
        pii.find(text)


def test_disclosing_terms_go_wherever_they_stand_in_the_text(spark):
    """Names 200 words from the entity, of an entity of several documents and of one of a single document; common words stay."""
    filler = " ".join(f"f{i}" for i in range(200))
    texts = [f"Dear Zora {filler} v{i} regards zora.q@mail.example.com end {filler} ZORA" for i in range(4)]
    texts += [f"plain text number p{i} end regards dear {filler}" for i in range(300)]
    texts += ["Zora elsewhere", f"Orla {filler} other.p@mail.example.com", f"plain {filler}"]
    docs = docs_df(spark, list(enumerate(texts)))
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == "term"] for r in pii.scan_personal_data(docs).collect()}
    assert all({"Zora", "ZORA", f"v{i}"} == set(got[i]) for i in range(4))
    assert got[305] == ["Orla"] and got[304] == [] and got[306] == [] and got[100] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zora" in clean[i].lower() for i in range(4)) and clean[0].startswith("Dear <NAME> f0")
    assert clean[304] == texts[304] and clean[305].startswith("<NAME> f0")


def test_copies_and_templates_are_one_document(spark):
    """A text repeated, or with another entity in it, tells no more than once."""
    texts = ["call Mira on 1.2.3.4 now"] * 5 + ["call Mira on 1.2.3.5 now", "call Otto on 1.2.3.4 later"] + [f"call now later on w{i}" for i in range(60)]
    got = {(r.doc_id, s.start, s.end) for r in pii.scan_personal_data(docs_df(spark, list(enumerate(texts)))).collect()
           for s in r.spans if s.kind == "term"}
    assert got == brute_terms(texts) and got


def test_entity_of_every_document_discloses_nothing(spark):
    texts = [f"w{i} 1.2.3.4" for i in range(5)]
    assert not [s for r in pii.scan_personal_data(docs_df(spark, list(enumerate(texts)))).collect() for s in r.spans if s.kind == "term"]


def test_a_long_list_of_addresses(spark):
    """Entities of the same documents are scored as one: 4 MB of addresses and words take little time and memory."""
    import resource
    import time
    text = " ".join(f"name{i} user{i}@host{i % 1000}.example.com" for i in range(110_000))
    assert len(text) > 4_000_000
    at, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spans = pii.find(text)
    hashes, (_, words) = pii._entity_ids(text, spans), pii.Words().document(text, spans)
    pii._span_array([spans])
    assert len(hashes) == len(words) == 110_000
    assert time.process_time() - at < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
    docs = docs_df(spark, [(0, text), *[(i, f"plain words {i}") for i in range(1, 9)]])
    [row] = [r for r in pii.scan_personal_data(docs).collect() if r.doc_id == 0]
    assert sum(s.kind == "term" for s in row.spans) == 110_000
