"""License scan by ordered signature rules.

Every rule is a regular expression over the lower-cased text, gated by a keyword that any text it
matches must hold; a text is only searched for rules whose keyword it holds. License expressions behind an
identifier tag give a detection for each identifier. Detections are resolved by priority: a detection that lies within one of higher priority (or as high and longer)
is suppressed. Three base phrases are always reported, whatever else is detected around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import EXCEPTIONS, IDENTIFIERS, SENTENCES, TITLES
from .pii import WORD_BYTES
from .tables import text_steps

WORD = "0-9a-z\x80-\U0010ffff"

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: A license's label, a keyword that its name holds however it is separated, and its name (a blank stands for any separators).
LICENSES = (
    ("mit", "mit", r"mit"),
    ("apache-1.1", "apache", r"apache(?: software)? license v(?:ersion)? ?1 1"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: v| version)? ?2(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public license v(?:ersion)? ?1"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license,? v(?:ersion)? ?2"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license,? v(?:ersion)? ?3"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?2 1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license"),
    ("mpl-1.1", "mozilla", r"mozilla public license v(?:ersion)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license v(?:ersion)? ?2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license v(?:ersion)? ?2 0"),
    ("eupl-1.2", "european", r"european union public license(?: v(?:ersion)? ?1 2)?"),
    ("cddl-1.0", "common development", r"common development and distribution license"),
    ("cpl-1.0", "common public", r"common public license"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("bsl-1.0", "boost", r"boost software license"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "what the", r"do what the f\w+ you want to public license"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic license(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("python-2.0", "python", r"python software foundation license"),
    ("php-3.01", "php", r"php license(?: version)? ?3 01"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("odbl-1.0", "open database", r"open(?: data commons)? database license"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by", "attribution", r"creative commons attribution(?: \d \d)?(?: international)?"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike(?: \d \d)?(?: international)?"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial(?: \d \d)?(?: international)?"),
    ("cc-by-nd", "deriv", r"creative commons attribution no ?deriv\w*(?: \d \d)?(?: international)?"),
    ("cc-by-nc-sa", "commercial", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?"),
)

#: How texts speak of a license: rule name, phrase around the name, priority, weight.
FORMS = (
    ("licensed-under", r"licen[sc]ed under(?: the)?(?: terms of)?(?: the)? {}", 80, 0.95),
    ("released-under", r"(?:released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? {}", 78, 0.9),
    ("subject-to", r"(?:subject to|governed by|in accordance with|compliance with)(?: the)?(?: terms of)?(?: the)? {}", 74, 0.85),
    ("terms-of", r"(?:terms|conditions|provisions) of(?: the)? {}", 70, 0.8),
    ("copy-of", r"(?:copy|text) of(?: the)? {}(?: license)?", 66, 0.8),
    ("license-field", r"licen[sc]e (?:is )?(?:the )?{}", 62, 0.7),
    ("name-license", r"{} licen[sc]e", 60, 0.75),
)

#: Phrases of license texts and notices: label, keyword, phrase, priority, weight.
NOTICES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 90, 0.97),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 90, 0.95),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 90, 0.95),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 88, 0.95),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software", 89, 0.9),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0", 92, 0.99),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it", 88, 0.95),
    ("gpl-2.0-or-later", "any later version", "either version 2 of the license or at your option any later version", 91, 0.97),
    ("gpl-3.0-or-later", "any later version", "either version 3 of the license or at your option any later version", 91, 0.97),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it", 89, 0.95),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 92, 0.99),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 92, 0.99),
    ("zlib", "provided", "this software is provided as is without any express or implied warranty", 70, 0.7),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 72, 0.85),
    ("public-domain", "public domain", r"(?:is|are) in the public domain", 64, 0.6),
    ("cc", "creative commons", r"creative commons", 30, 0.4),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: \d \d)?(?! nc| nd| sa)", 94, 0.98),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa", 95, 0.98),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?! nd| sa)", 95, 0.98),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd", 95, 0.98),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa", 96, 0.98),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd", 96, 0.98),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero", 96, 0.98),
    ("cc-by-sa", "cc", r"cc by sa(?: \d \d)?", 65, 0.8),
    ("cc-by-nc", "cc", r"cc by nc(?: \d \d)?", 65, 0.8),
    ("cc-by-nd", "cc", r"cc by nd(?: \d \d)?", 65, 0.8),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d \d)?", 66, 0.85),
    ("gpl", "gpl", r"(?:under|licen[sc]ed|terms of)(?: the)? (?:gnu )?gpl", 61, 0.7),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 76, 0.85),
    ("proprietary", "agreement", r"end user licen[sc]e agreement", 58, 0.6),
    ("proprietary", "written", r"without (?:the )?(?:prior )?(?:express )?written permission", 55, 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 35, 0.3),
)


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float


def _compiled(phrase: str) -> re.Pattern:
    between = phrase.replace(" ?", f"[^{WORD}]*").replace(" ", f"[^{WORD}]+")
    return re.compile(f"(?<![{WORD}])(?:{between})(?![{WORD}])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules in order: every license in every form, titles, exceptions, sentences of texts, and notices."""
    out = []
    for i, (label, keyword, name) in enumerate(LICENSES):
        out += [Rule(f"{form}:{label}:{i}", label, keyword.split(" ")[0], _compiled(phrase.format(f"(?:{name})")), priority, weight)
                for form, phrase, priority, weight in FORMS]
    out += [Rule(f"title:{label}:{i}", label, keyword, _compiled(phrase), 68, 0.8) for i, (label, keyword, phrase) in enumerate(TITLES)]
    out += [Rule(f"exception:{label}:{i}", label, keyword, _compiled(phrase), 94, 0.9) for i, (label, keyword, phrase) in enumerate(EXCEPTIONS)]
    out += [Rule(f"sentence:{label}:{i}", label, keyword, _compiled(phrase), priority, weight)
            for i, (label, keyword, phrase, priority, weight) in enumerate(SENTENCES)]
    out += [Rule(f"notice:{i}", label, keyword.split(" ")[0], _compiled(phrase), priority, weight)
            for i, (label, keyword, phrase, priority, weight) in enumerate(NOTICES)]
    return tuple(out)


#: Every match of a rule holds one of these; a text without them is not searched further.
GATES = ("licen", "copyright", "permission", "rights", "public", "redistribut", "spdx", "creative", "cc", "gpl", "proprietary",
         "software", "exception", "liable", "warrant", "apache", "cecill", "mulan", "bsd", "altered", "attribution", "deriv", "enhancements",
         "functionality", "loss", "machine", "agreement", "neither", "remotely", "reserved", "trade", "unauthorized", "grant", "distribut", "copy", "under", "subject", "governed", "accordance", "compliance", "terms", "conditions", "provisions", "text")


_TAG = re.compile(f"(?<![{WORD}])spdx[ -]license[ -]identifier[ \\t]*[:=]?[ \\t]*")
_TOKEN = re.compile(r"[ \t()]*([0-9a-z][0-9a-z.+-]*)")


def expressions(low: str) -> list[dict]:
    """A detection per identifier of each license expression, up to the first word that is neither known nor an operator.

    "x-only" counts as x, "x+" as "x-or-later"; what follows "with" is an exception under its own name.
    """
    found = []
    for tag in _TAG.finditer(low):
        at, exception = tag.end(), False
        while m := _TOKEN.match(low, at):
            word, at = m[1].rstrip("."), m.end()
            if word in ("and", "or"):
                continue
            if word == "with":
                exception = True
                continue
            name = word.removesuffix("-only") if not word.endswith("+") else word[:-1] + "-or-later"
            if not exception and name.removesuffix("-or-later") not in IDENTIFIERS:
                break
            found.append({"rule": "expression", "label": name, "start": m.start(1), "end": m.start(1) + len(word), "priority": 100, "weight": 1.0})
            exception = False
    return found


class Scanner:
    def __init__(self) -> None:
        self.base = [(label, phrase.split(" "), _compiled(phrase)) for phrase, label in BASE.items()]
        self.by_keyword: dict[str, list[Rule]] = {}
        for r in rules():
            self.by_keyword.setdefault(r.keyword, []).append(r)

    def find(self, low: str) -> list[dict]:
        """Detections of a lower-cased text: base places, and rules that are not suppressed, by start."""
        found = [{"rule": "base", "label": label, "start": m.start(), "end": m.end(), "priority": 50, "weight": 0.6}
                 for label, words, pattern in self.base if all(w in low for w in words) for m in pattern.finditer(low)]
        if "spdx" in low:
            found += expressions(low)
        for keyword, held in self.by_keyword.items():
            if keyword in low:
                found += [{"rule": r.name, "label": r.label, "start": m.start(), "end": m.end(), "priority": r.priority,
                            "weight": r.weight} for r in held for m in r.pattern.finditer(low)]
        return resolved(found)


def resolved(found: list[dict]) -> list[dict]:
    """Detections that none of higher priority, and none as high and as long, contains; base places always stay.

    Those that are themselves suppressed may suppress: what contains them contains theirs as well.
    """
    out, furthest = [], {}  # by priority: the furthest end of what has begun
    for d in sorted(found, key=lambda d: (d["start"], -d["end"], -d["priority"], d["rule"])):
        if d["rule"] == "base" or not any(p >= d["priority"] and e >= d["end"] for p, e in furthest.items()):
            out.append(d)
        furthest[d["priority"]] = max(d["end"], furthest.get(d["priority"], 0))
    return out


DETECTION = "struct<rule:string,label:string,start:int,end:int,word:long,weight:double>"
ARROW_DETECTIONS = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("word", pa.int64()), ("weight", pa.float64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, detections) of every whole text, detections by start.

    A detection has its rule ("base" for a base phrase), label, start and end in code points, the
    number of words before it, and a weight. A null text is empty; repeated rows and null ids
    stay; an empty table gives no rows; extra columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, word = Scanner(), re.compile(f"[{WORD}]+")
        for batch in batches:
            for part in text_steps(batch, "text"):
                texts = [t.as_buffer().to_pybytes().lower() for t in part.column("text")]  # of bytes: A-Z only
                inside = np.concatenate([[False], WORD_BYTES[np.frombuffer(b" ".join(texts), np.uint8)]])
                begun = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])
                at = np.minimum(np.cumsum([0] + [len(t) + 1 for t in texts]), len(begun) - 1)
                found = []
                for t in texts:
                    low = t.decode() if any(g in t for g in gates) else ""
                    hits = scanner.find(low) if low else []
                    words, before = 0, 0
                    for d in hits:
                        words += len(word.findall(low, before, d["start"]))
                        before = d["start"]
                        d["word"] = words
                    found.append([{k: d[k] for k in ("rule", "label", "start", "end", "word", "weight")} for d in hits])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(begun[at])),
                                       "detections": pa.array(found, ARROW_DETECTIONS)})

    gates = [g.encode() for g in GATES]
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_words long, detections array<{DETECTION}>"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 less the product of 1 - weight)."""
    base = F.filter("detections", lambda d: d["rule"] == "base")
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    words = F.transform(base, lambda d: d["word"])
    miss = F.aggregate("detections", F.lit(1.0), lambda s, d: s * (F.lit(1.0) - d["weight"]))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), labels(base).alias("base_labels"),
                        labels(F.col("detections")).alias("labels"), (F.lit(1.0) - miss).alias("score"))
