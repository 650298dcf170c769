"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation around them.

E-mail and IP addresses, card and phone numbers are the protected entities. Other words of the documents that hold an
entity may give it away. Corpus co-occurrence tells how far: with P(t|e) the share of an entity's distinct documents
that hold term t, and P(t) the share of all documents that hold it, the term reveals PMI = log2(P(t|e) / P(t))
bits of the entity's information content IC = -log2(documents of e / all documents). A term that reveals at least ``threshold``
of IC is a disclosure, wherever in the document it stands: it is generalised (numbers, names) or removed at every place of
the texts that hold the entity. Texts of the same words (copies, or a template with other entities in it) are one
document in P(t|e). A term can only disclose an entity if it is rare enough, so words that are not are left out before any
join. Entities of exactly the same documents score alike, so that they are scored together: a list of a hundred thousand
addresses is one group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playerlytics.functions.bounded import bounded_rows

from .sketch import Shingles
from .spans import ARROW_SPANS, SPANS, Span
from .tables import stored, text_steps

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "term"]

_EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")  # a match ends where its digits end
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Words of contexts, on bytes: ASCII letters and digits, and all of other scripts.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches in linear time: from each @ back to where its name can start."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _EMAIL_NAME:
            start -= 1
        host = _EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
        after = host.end() if host else at + 1
        at = text.find("@", after)


def find(text: str) -> list[Span]:
    """The base spans of a text: leftmost, non-overlapping per kind; matches that fail a check are dropped."""
    found = list(_emails(text))
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text)
                  if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _entity(kind: str, value: str) -> bytes:
    plain = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
    return f"{kind} {plain}".encode()


def _entity_ids(text: str, spans: list[Span]) -> list[int]:
    """The distinct entities of a text, by hash."""
    return list({xxhash.xxh64_intdigest(_entity(k, text[s:e])) - (1 << 63) for k, s, e in spans})


class Words:
    """The words of a text that no span overlaps, by hash, and where they stand."""

    def __init__(self):
        self.words = Shingles(1, WORD_BYTES)

    def free(self, text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (in code points) and hashes of the words that no span overlaps."""
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, terms = self.words.word_hashes(raw)
        if len(raw) != len(text):
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
            starts, ends = chars[starts], chars[ends]
        at = np.array([x[1:] for x in spans], np.int64).reshape(-1, 2)
        step = np.zeros(len(starts) + 1, np.int64)
        first, last = np.searchsorted(ends, at[:, 0], side="right"), np.searchsorted(starts, at[:, 1])
        some = first < last
        np.add.at(step, first[some], 1)
        np.add.at(step, last[some], -1)
        free = np.cumsum(step[:-1]) == 0
        return starts[free], ends[free], terms[free]

    def document(self, text: str, spans: list[Span]) -> tuple[int, np.ndarray]:
        """A hash of the free words in their order, and the distinct ones."""
        terms = self.free(text, spans)[2]
        return xxhash.xxh64_intdigest(terms.tobytes()) - (1 << 63), np.unique(terms).view(np.int64)


def _lists(found: list[np.ndarray | list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int64) for x in found]) if found else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _span_array(found: list[list[Span]]) -> pa.Array:
    """Spans by start, then kind as in ``KINDS``, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    flat = [x for spans in found for x in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))]
    kinds = pa.array([k for k, _, _ in flat], pa.string())
    places = np.array([x[1:] for x in flat], np.int32).reshape(-1, 2)
    struct = pa.StructArray.from_arrays([kinds, pa.array(places[:, 0]), pa.array(places[:, 1])], fields=list(ARROW_SPANS.value_type))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), struct)


def _found_spans(column: pa.Array) -> list[list[Span]]:
    flat = column.flatten()
    rows = list(zip(*(flat.field(i).to_pylist() for i in range(3)))) if len(flat) else []
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).tolist()
    return [rows[i:j] for i, j in zip(bounds, bounds[1:])]


def _detected(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """Stored table (rid, doc_id, spans, entities, document, words, row or text): of each row its base spans; of those that
    have any the distinct entities, a hash of the other words and the distinct ones, and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, none = Words(), (0, np.zeros(0, np.int64))
        for batch in batches:
            if keep:
                texts = pc.fill_null(pc.struct_field(batch.column("row"), text_col), "")
                batch = batch.append_column("text", texts)
            for part in text_steps(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [find(t) for t in texts]
                held = [words.document(t, x) if x else none for t, x in zip(texts, found)]
                out = {"rid": part.column("rid"), "doc_id": part.column("doc_id"), "spans": _span_array(found),
                       "entities": _lists([_entity_ids(t, x) for t, x in zip(texts, found)]),
                       "document": pa.array([d for d, _ in held], pa.int64()), "words": _lists([t for _, t in held])}
                if keep:
                    out["row"] = part.column("row")
                else:
                    out["text"] = pa.array([t if x else None for t, x in zip(texts, found)], pa.string())
                yield pa.record_batch(out)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       F.struct(*docs.columns).alias("row") if keep else F.coalesce(text_col, F.lit("")).alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([rows.schema["rid"], rows.schema["doc_id"], T.StructField("spans", T.DataType.fromDDL(SPANS)),
                           T.StructField("entities", longs), T.StructField("document", T.LongType()), T.StructField("words", longs),
                           rows.schema["row"] if keep else T.StructField("text", T.StringType())])
    return stored(rows.mapInArrow(run, schema), "personal-data")


def document_frequency(docs: DataFrame, text_col: str = "text", most: int = 1 << 19) -> DataFrame:
    """(term, n): in how many documents each word stands, over all documents; counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held = Shingles(1, WORD_BYTES), []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            terms, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            terms, n = summed()
            return pa.record_batch({"term": pa.array(terms.view(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for part in text_steps(batch, "text"):
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                starts, _, words = shingles.word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
                at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
                each = [np.unique(words[i:e]) for i, e in zip(at[:-1], at[1:])]
                held.append(np.unique(np.concatenate(each), return_counts=True))
                if sum(len(t) for t, _ in held) > most:
                    held = [summed()]
                    if len(held[0][0]) > most // 2:
                        yield rows()
                        held = []
        if held:
            yield rows()

    counted = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(found: DataFrame, docs: DataFrame, text_col: str, threshold: float) -> DataFrame:
    """(rid, terms): the words of each row, by hash, that disclose an entity that the row holds; rows without any are left out."""
    total = float(found.count())
    held = found.where(F.size("spans") > 0)
    seen = stored(held.select(F.explode("entities").alias("entity"), "document").distinct(), "entity-documents")
    # the set of an entity's documents, by two hashes of each of them or-ed exclusively
    sets = seen.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("document")).alias("x"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "document")).alias("y"))
    sets = stored(sets.where(F.col("n_e") < total).select("entity", "n_e", F.xxhash64("n_e", "x", "y").alias("group")), "entities")
    groups = stored(seen.join(sets, "entity").select("group", "n_e", "document").distinct(), "entity-groups")
    # share >= threshold needs df <= n_e (N / n_e)^(1 - threshold), as a term is in n_e of the documents at most
    n_e, n = F.col("n_e"), F.lit(total)
    most = n_e * F.pow(n / n_e, F.lit(1 - threshold)) * F.lit(1 + 1e-9)
    bound = bounded_rows(groups.agg(F.max(most).alias("most")), 1)[0].most or 0.0
    rare = document_frequency(docs, text_col).where(F.col("n") <= bound).select("term", F.col("n").alias("df"))
    words = held.select("document", F.explode("words").alias("term")).distinct().join(stored(rare, "rare-terms"), "term")
    both = stored(groups.join(stored(words, "document-terms"), "document").where(F.col("df") <= most)
                  .select("group", "n_e", "document", "term", "df"), "entity-terms")
    share = F.log2(F.col("n_te") / n_e * n / F.col("df")) / F.log2(n / n_e)
    pairs = (both.groupBy("group", "n_e", "term", "df").agg(F.count("*").alias("n_te"))
             .where(share >= threshold - 1e-12).select("group", "term"))
    # the disclosing words of each document and group of entities in it
    given = both.join(stored(pairs, "disclosures"), ["group", "term"]).groupBy("document", "group").agg(F.collect_list("term").alias("terms"))
    own = held.select("rid", "document", F.explode("entities").alias("entity")).join(sets, "entity").select("rid", "document", "group").distinct()
    return own.join(stored(given, "document-disclosures"), ["document", "group"]).groupBy("rid") \
        .agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def _with_terms(batch: pa.RecordBatch, words: Words) -> list[list[Span]]:
    """All spans of each row (text, spans, terms), those of its terms included."""
    out = []
    for text, spans, terms in zip(batch.column("text").to_pylist(), _found_spans(batch.column("spans")), batch.column("terms").to_pylist()):
        if terms:
            starts, ends, hashes = words.free(text, spans)
            at = np.isin(hashes.view(np.int64), np.array(terms, np.int64))
            spans = spans + [("term", s, e) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        out.append(spans)
    return out


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, spans): base spans and disclosing terms of every whole text, by start, then kind as in ``KINDS``.

    A null text is empty; repeated rows and null ids stay, each row for itself (all rows count in the
    frequency of words, equal ones once in P(t|e)); an empty table gives no rows; extra columns are not read. An
    entity of every document discloses nothing and has nothing to disclose.
    """
    found = _detected(docs, id_col, text_col, keep=False)
    terms = disclosures(found, docs, text_col, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in text_steps(batch, "text"):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "spans": _span_array(_with_terms(part, words))})

    every = found.join(terms, "rid", "left").select("doc_id", "spans", "terms", "text")
    return every.mapInArrow(run, T.StructType([every.schema["doc_id"], every.schema["spans"]]))


def _replacement(kind: str, value: str) -> str:
    if kind != "term":
        return f"<{kind.upper()}>"
    return "<NUMBER>" if any(c.isdigit() for c in value) else "<NAME>" if value[:1].isupper() else ""


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with identifiers and terms generalised or removed; overlapping spans go as one, by the first kind."""
    rank = {k: i for i, k in enumerate(KINDS)}
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])):
        if start >= at:
            out += [text[at:start], _replacement(kind, text[start:end])]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
             threshold: float = 0.8) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in the texts generalised or removed.

    Only rows that hold any are shuffled and changed; their ``length_col``, if there is one, is set
    to the new length. Null texts stay null.
    """
    found = _detected(docs, id_col, text_col, keep=True)
    text = F.col(f"row.`{text_col}`")
    terms = disclosures(found, docs, text_col, threshold)
    touched = F.size("spans") > 0
    changed = (found.where(touched).select("rid", "spans", "row").join(terms, "rid", "left")
               .select("spans", "terms", text.alias("text"), "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in text_steps(batch, "text"):
                texts = [sanitised(t, s) for t, s in zip(part.column("text").to_pylist(), _with_terms(part, words))]
                yield pa.record_batch({"text": pa.array(texts, pa.string()), "row": part.column("row")})

    new = changed.mapInArrow(run, T.StructType([changed.schema["text"], changed.schema["row"]]))
    now = {text_col: F.col("text"), length_col: F.length("text").cast(docs.schema[length_col].dataType)
           if length_col in docs.columns else None}
    columns = [now[c].alias(c) if now.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns]
    return new.select(*columns).unionByName(found.where(~touched).select(*[F.col(f"row.`{c}`") for c in docs.columns]))
