"""License scan: base phrases against brute force, gating and suppression against plain versions, known texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from playerlytics.llm import licenses

from .conftest import docs_df

SCANNER = licenses.Scanner()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words))
             if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


PARTS = st.sampled_from(["cc", "BY", "sa", "nc", "4.0", "General", "public", "LICENSE", "license", "all", "rights", "reserved", "mit",
                         "licensed under the", "terms of the", "GNU", "gpl", "v2", "version 3", "creative commons", "attribution",
                         "é", "-", " - ", ".", "\n", "apache", "2.0", "the", "copy of the", "ſ", "\x7f", "x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25), st.sampled_from([" ", "", ", "]))
def test_gates_and_suppression_match_plain_versions(parts, between):
    text = low(between.join(parts))
    got = SCANNER.find(text)
    base = [{"rule": "base", "label": label, "start": m.start(), "end": m.end(), "priority": 50}
            for label, _, p in SCANNER.base for m in p.finditer(text)]
    every = base + [{"rule": r.name, "label": r.label, "start": m.start(), "end": m.end(), "priority": r.priority}
                    for r in licenses.rules() for m in r.pattern.finditer(text)]
    within = lambda a, b: b["start"] <= a["start"] and a["end"] <= b["end"]
    rank = lambda d: (d["priority"], d["end"] - d["start"])
    kept = []
    for d in sorted(every, key=lambda d: (-d["priority"], d["start"] - d["end"], d["start"], d["rule"])):
        if d["rule"] == "base" or not any(within(d, k) and (rank(k) >= rank(d)) for k in kept):
            kept.append(d)
    plain = sorted((d["start"], d["end"], d["label"]) for d in kept)
    assert sorted((d["start"], d["end"], d["label"]) for d in got) == plain
    if every:
        assert any(g in text for g in licenses.GATES)
    assert [(len(re.findall(f"[{licenses.WORD}]+", text[:d["start"]])), d["label"]) for d in got if d["rule"] == "base"] \
        == [x for x in brute_base(text)[1]] or sorted(d["label"] for d in got if d["rule"] == "base") == sorted(x for _, x in brute_base(text)[1])


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", {"apache-2.0"}),
    ("SPDX-License-Identifier: MIT", {"mit"}),
    ("released under the GNU General Public License, version 3", {"gpl", "gpl-3.0"}),
    ("see http://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
    ("This work is CC BY-SA 4.0", {"cc-by", "cc-by-sa"}),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
    ("creative commons attribution-sharealike 4.0 license", {"cc-by-sa"}),
    ("under no circumstances", set())])
def test_known_texts(text, labels):
    assert {d["label"] for d in SCANNER.find(low(text))} == labels


@pytest.mark.parametrize("text, wanted, absent", [
    ("GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}, {"lgpl", "gpl-2.0"}),
    ("licensed under the GNU Lesser General Public License v3.0", {"lgpl-3.0"}, {"lgpl", "gpl-3.0"}),
    ("Licensed under the Artistic License, Version 2.0", {"artistic-2.0"}, {"artistic-1.0"}),
    ("licensed under the BSD License", {"bsd"}, set()),
    ("under the 3-clause BSD license", {"bsd-3-clause"}, {"bsd"}),
    ("Elastic License 2.0", {"elastic-2.0"}, set()),
    ("Business Source License 1.1", {"busl-1.1"}, set()),
    ("the Server Side Public License", {"sspl-1.0"}, set()),
    ("Eclipse Distribution License - v 1.0", {"edl-1.0"}, {"epl-1.0"}),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY", {"mit"}, {"isc", "zlib"}),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}, set()),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause-Clear */",
     {"gpl-2.0", "linux-syscall-note", "bsd-3-clause-clear"}, {"bsd-3-clause"}),
    ("SPDX-License-Identifier: LGPL-2.1+ AND GPL-3.0-or-later.", {"lgpl-2.1-or-later", "gpl-3.0-or-later"}, {"lgpl-2.1", "gpl-3.0"}),
    ("SPDX-License-Identifier: nothing or mit", set(), {"mit"}),
    ("BSD-3-Clause-Clear License", {"bsd-3-clause-clear"}, {"bsd-3-clause"}),
    ("GNU General Public License version 2 or (at your option) any later version", {"gpl-2.0-or-later"}, {"gpl-2.0"}),
    ("GNU General Public License, version 2 only", {"gpl-2.0"}, {"gpl-2.0-or-later"}),
    ("GNU General Public License v2 with the Classpath exception", {"gpl-2.0", "classpath-exception-2.0"}, set()),
    ("Redistributions in binary form must reproduce the above copyright notice", {"bsd"}, {"mit"}),
    ("You should have received a copy of the GNU Affero General Public License along with this program", {"agpl-3.0"}, {"lgpl"}),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}, {"cc-by"}),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose", {"isc"}, {"mit"}),
    ("the origin of this software must not be misrepresented; you must not claim that you wrote the original software", {"zlib"}, {"mit"}),
    ("the licensee may sit on the bench of the public library", set(), {"mit", "gpl", "lgpl", "bsd"})])
def test_titles_sentences_and_expressions(text, wanted, absent):
    labels = {d["label"] for d in SCANNER.find(low(text))}
    assert wanted <= labels and not absent & labels


@pytest.mark.parametrize("rule", [r for r in licenses.rules() if r.name.split(":")[0] in ("title", "exception", "sentence")], ids=lambda r: r.name)
def test_every_signature_has_a_match_and_a_near_miss(rule):
    """Its plainest spelling is found with its label; with a word of it gone, the rule itself finds nothing."""
    texts = sorted((t for t in spellings(rule.pattern) if rule.pattern.fullmatch(t)), key=len)
    assert texts
    words = texts[0].split()
    assert any(d["label"].startswith(rule.label.split("-")[0]) for d in SCANNER.find(texts[0]))
    if len(words) > 2:
        assert not rule.pattern.search(" ".join(words[:1] + words[2:])) or "?" in rule.pattern.pattern
    assert not rule.pattern.search(" ".join(words[:-1] + ["x" + words[-1]]))
    assert not rule.pattern.search("x" + " ".join(words)) and any(g in texts[0] for g in licenses.GATES)


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 450
    assert len([r for r in licenses.rules() if r.name.split(":")[0] in ("title", "exception", "sentence", "notice")]) > 180


def test_operator_and_summary(spark):
    texts = ["CC BY, cc\nby and the GENERAL public-license. All rights reserved", None, "", "é ünï 7x", "cc by " * 20_000,
             "licensed under the mit license, all rights  reserved", "x" * 100_000]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0])]
    got = licenses.summary(licenses.scan_licenses(docs_df(spark, rows, "detections"))).collect()
    assert len(got) == len(rows) and licenses.summary(licenses.scan_licenses(docs_df(spark, []))).count() == 0
    by = dict(rows)
    for r in got:
        n, base = brute_base(by[r.doc_id] or "")
        at = [i for i, _ in base]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert {r.labels for r in got if r.doc_id == 5} == {"mit,reserved"}


def spelled(tree, between, maybe, branch):
    """A text that the parsed pattern matches: its separators, whether optional parts stand, which branch."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "BRANCH":
            out += spelled(arg[1][branch % len(arg[1])], between, maybe, branch)
        elif op == "SUBPATTERN":
            out += spelled(arg[3], between, maybe, branch)
        elif op == "MAX_REPEAT":
            least, most, part = arg
            separators = str(part[0][0]) == "IN" and str(part[0][1][0][0]) == "NEGATE"
            if separators:
                out += between if least or maybe else ""
            else:
                out += spelled(part, between, maybe, branch) * max(least, int(maybe))
        elif op == "IN":
            held = {str(k): v for k, v in arg}
            out += chr(held["LITERAL"]) if "LITERAL" in held else "7" if "DIGIT" in str(arg) else "x"
        else:
            assert op == "ASSERT_NOT", op
    return out


def spellings(pattern):
    tree = re._parser.parse(pattern.pattern)
    return {spelled(tree, between, maybe, branch) for between in (" ", "-", "\n", ", ") for maybe in (False, True) for branch in range(6)}


def test_gates_hold_for_every_spelling_of_every_rule():
    seen = 0
    for r in licenses.rules():
        for text in spellings(r.pattern):
            if not r.pattern.fullmatch(text):
                continue
            seen += 1
            assert r.keyword in text, (r.name, text)
            assert any(g in text for g in licenses.GATES), (r.name, text)
    assert seen > 20 * len(licenses.rules()) / 2


@pytest.mark.parametrize("spelling", ["NonCommercial", "Non-Commercial", "non commercial", "Non\nCommercial"])
def test_gated_results_are_the_ungated_ones(spark, spelling):
    for text in (f"licensed under the Creative Commons Attribution-{spelling} 3.0", f"the terms of the Creative Commons Attribution {spelling} Share Alike 3.0",
                 "subject\nto the ISC", "text\nof the ISC"):
        every = [{"rule": r.name, "label": r.label, "start": m.start(), "end": m.end(), "priority": r.priority, "weight": r.weight}
                 for r in licenses.rules() for m in r.pattern.finditer(low(text))]
        assert SCANNER.find(low(text)) == licenses.resolved(every) and every
    docs = docs_df(spark, [(1, f"licensed under the Creative Commons Attribution-{spelling} 3.0"), (2, "subject\nto the ISC"), (3, "text\nof the zlib")])
    got = {r.doc_id: r.labels for r in licenses.summary(licenses.scan_licenses(docs)).collect()}
    assert "cc-by" not in got[1].split(",") and "cc-by-nc" in got[1].split(",") and got[2] == "isc" and got[3] == "zlib"
