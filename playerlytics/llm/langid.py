"""Language identification by Bayesian evidence fusion.

For each language l the log posterior adds up
 - the text: log-likelihood of its byte trigrams under l (each letter is in three, so a third counts),
 - the declared language (markup or metadata): log P(declared | l),
 - the address suffix: log P(suffix | l),
 - the host's prior P(l | host), smoothed towards its domain's, and that towards the overall prior.
The last three are counted by grouped aggregation over all rows, by the rows' languages as their
texts alone tell them where they are sure. A further outcome, no language, gives every trigram the
same chance; rows that it wins, rows without a letter, and rows without a clear winner are rejected.
Every language that a text with a letter declares is told apart. The trigram model is fitted on a
bounded sample: of each declared language the ``per_language`` (or about as many) distinct texts of
the smallest hash; its counts are smoothed towards those of all languages together, which carries
languages of few texts. All else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from .tables import stored, text_steps

#: Buckets of trigrams, added count of each, and how many primary subtags of two or three letters there can be.
BUCKETS, ADDED, ALL_TAGS = 1 << 16, 0.5, 26 ** 2 + 26 ** 3
#: Counts of (language, bucket) that a task holds before it passes them on.
HELD_COUNTS = 1 << 20
#: Prior of "no language"; strength of a parent's prior; added count of declared languages and suffixes.
NONE_PRIOR, STRENGTH, ADDED_EVIDENCE = 0.01, 20.0, 1.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-probabilities: language, bucket


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, whether it holds a letter, and where each text's begin (and the last's end)."""
    raw = _FOLD[np.frombuffer(b"  " + b"  ".join(texts) + b"  ", np.uint8)]
    wide = raw.astype(np.uint32)
    code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    letter = raw != 32
    return code, letter[:-2] | letter[1:-1] | letter[2:], np.cumsum([0] + [len(t) + 2 for t in texts])


def tag(declared: Column) -> Column:
    """The primary subtag, lower-cased; null if it is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]{2,3})([-_].*)?$", 1), F.lit(""))


def host(address: Column) -> Column:
    """The host of a url, or a bare host name, lower-cased; null if empty."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(address), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _table(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities from counts (language, bucket): the added mass is half even, half shared out as all languages' counts are."""
    every = counts.sum(axis=0, dtype=np.float64) + ADDED
    added = ADDED * (0.5 + 0.5 * BUCKETS * every / every.sum())
    table = np.empty(counts.shape, np.float32)
    for row, n in zip(table, counts):
        row[:] = np.log((n + added) / (n.sum(dtype=np.float64) + added.sum()))
    return table


def fit(df: DataFrame, per_language: int = 2000) -> Model:
    """The trigram model from columns text and declared (a tag): a language for every tag of a text with a letter."""
    told = (df.where(F.col("declared").isNotNull() & F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]"))
            .select("declared", "text", F.xxhash64("text").alias("h")))
    rows = told.select("declared", "h").distinct().groupBy("declared").agg(F.count("*").alias("n"))
    known = bounded_rows(rows, ALL_TAGS)
    languages = sorted(r.declared for r in known)
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32))
    least = {r.declared: per_language / r.n for r in known if r.n > per_language}
    share = F.coalesce(F.create_map(*[F.lit(x) for item in least.items() for x in item])[F.col("declared")], F.lit(1.0)) if least else F.lit(1.0)
    # hashes are even over the range of a long: the smallest share of them is about per_language texts
    sample = (told.where(F.col("h").cast("double") <= share * F.lit(2.0 ** 64) - F.lit(2.0 ** 63)).dropDuplicates(["declared", "h"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = {x: i for i, x in enumerate(languages)}, []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, i = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(i, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            keys, n = summed()
            return pa.record_batch({"language": pa.array(keys // BUCKETS), "bucket": pa.array(keys % BUCKETS), "n": pa.array(n)})

        for batch in batches:
            for part in text_steps(batch, "text"):
                code, letter, bounds = _trigrams([t.as_buffer().to_pybytes() for t in part.column("text")])
                of = np.repeat([at[x] for x in part.column("declared").to_pylist()], np.diff(bounds))
                keys = of * BUCKETS + code[:len(of)]
                held.append(np.unique(keys[letter[:len(of)]], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_COUNTS:
                    held = [summed()]
                    if len(held[0][0]) > HELD_COUNTS // 2:
                        yield rows()
                        held = []
        if held:
            yield rows()

    counted = (sample.select("declared", "text").mapInArrow(count, "language long, bucket long, n long")
               .groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas())  # <= languages x BUCKETS rows
    counts = np.zeros((len(languages), BUCKETS), np.int32)
    counts[counted["language"], counted["bucket"]] = counted["n"]
    return Model(languages, _table(counts))


def _text_evidence(df: DataFrame, model: Model) -> DataFrame:
    """Stored: the columns of ``df`` but text, with logs (a language each, then none), letters, and the text's sure winner."""
    flat = np.append(model.table, np.full((1, BUCKETS), -math.log(BUCKETS), np.float32), axis=0)
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                code, letter, bounds = _trigrams(texts)
                logs = np.empty((len(texts), len(flat)))
                for j, row in enumerate(flat):
                    sums = np.concatenate([[0.0], np.cumsum(row[code] * letter, dtype=np.float64)])
                    logs[:, j] = (sums[bounds[1:]] - sums[bounds[:-1]]) / 3
                n = np.concatenate([[0], np.cumsum(letter)])
                n = n[bounds[1:]] - n[bounds[:-1]]
                ranked = np.sort(logs, axis=1)
                sure = (n > 0) & (logs.argmax(axis=1) < len(flat) - 1) & (ranked[:, -1] - ranked[:, -2:-1].max(axis=1, initial=-np.inf) > 3)
                winner = np.where(sure, logs.argmax(axis=1), -1)
                out = {c: part.column(c) for c in names}
                out["logs"] = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(flat), logs.ravel())
                yield pa.record_batch(out | {"letters": pa.array(n), "winner": pa.array(winner)})

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != "text")
    return stored(df.mapInArrow(run, f"{fields}logs array<double>, letters long, winner long"), "language-evidence")


COUNTS = "array<struct<winner:long,n:long>>"


def _dense(column: pa.Array, k: int) -> np.ndarray:
    """Lists of (winner, n) as rows of ``k`` counts; a null list, and winner -1, count nothing."""
    out = np.zeros((len(column), k))
    at = np.asarray(pc.list_parent_indices(column))
    winner, n = (np.asarray(pc.struct_field(pc.list_flatten(column), f)) for f in ("winner", "n"))
    out[at[winner >= 0], winner[winner >= 0]] = n[winner >= 0]
    return out


def _host_evidence(told: DataFrame, k: int, totals: list[float]) -> DataFrame:
    """(known_host, evidence): log of the host's smoothed prior plus log P(suffix | l), a language each."""
    all_rows = np.array(totals)
    overall = (all_rows + 1) / (all_rows.sum() + k)
    labels = F.split("host", r"\.")
    counts = told.where(F.col("host").isNotNull()).groupBy("host", "winner").agg(F.count("*").alias("n")).withColumn(
        "domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn(
        "suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1)))
    listed = lambda df, keys, name: (df.groupBy(*keys, "winner").agg(F.sum("n").alias("n"))
                                     .groupBy(*keys).agg(F.collect_list(F.struct("winner", "n")).cast(COUNTS).alias(name)))
    hosts = listed(counts, ["host", "domain", "suffix"], "own")
    both = (hosts.join(listed(counts, ["domain"], "of_domain"), "domain")
            .join(listed(counts.where(F.col("suffix").isNotNull()), ["suffix"], "of_suffix"), "suffix", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = lambda n, parent: (n + STRENGTH * parent) / (n.sum(axis=1, keepdims=True) + STRENGTH)
        for batch in batches:
            own, domain, suffix = (_dense(batch.column(c), k) for c in ("own", "of_domain", "of_suffix"))
            # suffixes a language was not seen with share one added count with the rest of the suffixes
            said = np.log((suffix + ADDED_EVIDENCE) / (all_rows + 2 * ADDED_EVIDENCE)) * np.asarray(batch.column("of_suffix").is_valid())[:, None]
            found = np.log(prior(own, prior(domain, overall))) + said
            yield pa.record_batch({"known_host": batch.column("host"),
                                   "evidence": pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * k, found.ravel())})

    return both.select("host", "own", "of_domain", "of_suffix").mapInArrow(run, "known_host string, evidence array<double>")


def evidence(df: DataFrame, text: Column, declared: Column, address: Column, keep: dict[str, Column], per_language: int = 2000,
             min_confidence: float = 0.5) -> DataFrame:
    """The columns ``keep`` of every row with language, confidence, text_language, accepted.

    ``language`` is the winner over all evidence (null: none), ``confidence`` its posterior,
    ``text_language`` what the text alone says where it is sure. Null declared languages and
    addresses are no evidence; a null text is empty. Without rows, or without a declared language
    of a text with a letter, no row is accepted.
    """
    plain = df.select(*[c.alias(f"keep_{n}") for n, c in keep.items()], F.coalesce(text, F.lit("")).alias("text"),
                      tag(declared).alias("declared"), host(address).alias("host"))
    model = fit(plain, per_language)
    names, k = model.languages, len(model.languages)
    told = _text_evidence(plain, model)
    said = told.where(F.col("declared").isin(names) & (F.col("winner") >= 0)).groupBy("declared", "winner").agg(F.count("*").alias("n"))
    seen = {(r.declared, r.winner): r.n for r in bounded_rows(said, max(1, k * k))}
    sure = {r.winner: r.n for r in bounded_rows(told.where("winner >= 0").groupBy("winner").agg(F.count("*").alias("n")), k)}
    totals = [float(sure.get(i, 0)) for i in range(k)]
    markup = np.zeros((k + 1, k))  # declared (last: none that is known), language
    for (d, i), n in seen.items():
        markup[names.index(d), i] = n
    of = markup.sum(axis=0)
    markup[:k] = np.log((markup[:k] + ADDED_EVIDENCE * (1 + 9 * np.eye(k))) / (of + ADDED_EVIDENCE * (k + 9)))
    overall = np.log((np.array(totals) + 1) / (sum(totals) + k))
    if k:  # stored, so that both sides of the join are plain shuffles and a host of many rows can be split
        hosts = stored(_host_evidence(told, k, totals), "host-evidence")
        fused = told.join(hosts, F.col("host") == F.col("known_host"), "left")
    else:
        fused = told.withColumn("evidence", F.lit(None).cast("array<double>"))
    at, labels, kept = {x: i for i, x in enumerate(names)}, np.array([*names, None], object), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, given = batch.num_rows, batch.column("evidence")
            scores = np.array(pc.list_flatten(batch.column("logs"))).reshape(rows, k + 1)
            scores[:, :k] += markup[[at.get(x, k) for x in batch.column("declared").to_pylist()]] + math.log(1 - NONE_PRIOR)
            scores[:, k] += math.log(NONE_PRIOR)
            held = np.asarray(given.is_valid())
            scores[held, :k] += np.asarray(pc.list_flatten(given)).reshape(held.sum(), k)
            scores[~held, :k] += overall
            best, some = scores.argmax(axis=1), np.asarray(batch.column("letters")) > 0
            confidence = np.where(some, 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            language = labels[np.where(some, best, k)]
            yield pa.record_batch({**{n: batch.column(f"keep_{n}") for n in kept}, "language": pa.array(language, pa.string()),
                                   "confidence": pa.array(confidence),
                                   "text_language": pa.array(labels[np.asarray(batch.column("winner"))], pa.string()),
                                   "accepted": pa.array(some & (best < k) & (confidence >= min_confidence))})

    fields = "".join(f"`{n}` {told.schema[f'keep_{n}'].dataType.simpleString()}, " for n in kept)
    columns = [*[f"keep_{n}" for n in kept], "declared", "logs", "letters", "winner", "evidence"]
    return fused.select(*columns).mapInArrow(run, f"{fields}language string, confidence double, text_language string, accepted boolean")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
             address_col: str = "source", **options) -> DataFrame:
    """(id, language, confidence, text_language, accepted) of every row; see ``evidence``.

    Repeated rows and null ids stay; an empty table gives no rows; extra columns are not read.
    """
    return evidence(df, F.col(text_col), F.col(declared_col), F.col(address_col), {id_col: F.col(id_col)}, **options)


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """Pages by their visible text, the language their markup declares, and their url."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return evidence(pages, text, declared, F.col("url"), {"page_id": F.col("page_id")}, **options)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
               address_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    keys = {"_id": F.col(id_col), "_text": F.xxhash64(text_col), "_declared": F.col(declared_col), "_address": F.col(address_col)}
    found = evidence(docs, F.col(text_col), F.col(declared_col), F.col(address_col), keys, **options)
    rejected = found.where(~F.col("accepted")).select(*keys).distinct().alias("r")
    d = docs.alias("d")
    own = {"_id": F.col(f"d.`{id_col}`"), "_text": F.xxhash64(F.col(f"d.`{text_col}`")), "_declared": F.col(f"d.`{declared_col}`"),
           "_address": F.col(f"d.`{address_col}`")}
    same = [own[k].eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return d.join(rejected, same[0] & same[1] & same[2] & same[3], "left_anti")
