"""URL filter by association rules.

Labelled urls become sets of tokens (host labels with their place, path parts, extension, query
keys). A rule says that a url with all tokens of a set has the label that goes with it. Rules are
pruned by support and confidence, and a rule that a shorter one makes just as surely is left out.
Mining follows parallel FP-growth: each token's task gets the tokens more frequent than it of every
labelled url that holds it, and grows the sets of which it is the rarest. What cannot become a rule
is not grown: a set as frequent as one of its subsets, or one whose subset has a single label, says
no more than the subset. No token and no rule is left out for their number. Rules are matched by an
inverted index, a join: each stands under its rarest token, and a url looks up its own tokens and
checks the candidates' others. Given rules, by host and path prefix, come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from .tables import ragged_take, stored

#: Tokens of at least the minimum support (at most the tokens of a url / min_support); more are an error.
MOST_TOKENS = 1_000_000

_KEYS = re.compile(r"[?&]([^=&#?]+)=")
_PARTS = re.compile(r"[^/._~%+-]+")
_NUMBER = re.compile(r"[0-9]+")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(rules: list[tuple[str, str]], name: Column, way: Column) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host with path prefix) that fits, and its verdict (null: none fits)."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: -len(r[1])):
        at = text.index("/")
        fits = ((name == text[:at]) | name.endswith("." + text[:at])) & way.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule if rules else F.lit(None).cast("string"), verdict if rules else F.lit(None).cast("string")


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a url; numbers count as one token of their kind."""
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    name = re.match("[^/?#]*", rest)[0]
    way, _, query = rest[len(name):].partition("#")[0].partition("?")
    labels = [x for x in name.lower().split(".") if x]
    out = {f"h{i}:{x}" for i, x in enumerate(reversed(labels))}
    out |= {f"w:{x}" for x in _PARTS.findall(name.lower()) if x}
    for x in _PARTS.findall(way.lower()):
        out.add("p:#" if _NUMBER.fullmatch(x) else f"p:{x}")
    last = way.rpartition("/")[2]
    if "." in last:
        out.add("e:" + last.rpartition(".")[2].lower())
    if query:
        out |= {f"k:{x.lower()}" for x in _KEYS.findall("?" + query)}
    return sorted(out)


def with_tokens(rows: DataFrame) -> DataFrame:
    """Adds the array ``tokens`` to rows with a column url."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("tokens", pa.array([tokens(u) for u in batch.column("url").to_pylist()], pa.list_(pa.string())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, tokens array<string>")


def _grown(tokens: np.ndarray, bounds: np.ndarray, of: np.ndarray, n: np.ndarray,
           least: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, list[np.ndarray]]]:
    """Sets of tokens with their counts by label, and those of the subsets that lack one token.

    Row i has the ascending tokens between bounds i and i + 1, label ``of[i]``, and counts ``n[i]``
    times. Given are the empty set and all that some label has ``least`` times, none as frequent as
    a subset, none with a subset of a single label. Subsets come first.
    """
    labels = int(of.max()) + 1
    first = np.bincount(of, n, labels).astype(np.int64)
    mixed = {(): first}  # the sets that can grow
    yield (), first, []

    def grow(body: tuple[int, ...], rows: np.ndarray) -> Iterator:
        lengths = bounds[rows + 1] - bounds[rows]
        at, row = tokens[ragged_take(bounds[rows], lengths)], np.repeat(rows, lengths)
        if body:
            at, row = at[at > body[-1]], row[at > body[-1]]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        distinct, starts = np.unique(at, return_index=True)
        for i in range(len(distinct) - 1, -1, -1):  # the last first, so that all subsets are known
            own = row[starts[i]:starts[i + 1] if i + 1 < len(starts) else len(row)]
            counts = np.bincount(of[own], n[own], labels).astype(np.int64)
            if counts.max() < least:
                continue
            grown = (*body, int(distinct[i]))
            under = [mixed.get(grown[:j] + grown[j + 1:]) for j in range(len(grown))]
            if any(u is None or u.sum() == counts.sum() for u in under):
                continue
            yield grown, counts, under
            if counts.max() < counts.sum():
                mixed[grown] = counts
                yield from grow(grown, own)

    if first.max() < first.sum():
        yield from grow((), np.arange(len(of)))


def rule_table(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """Stored rules (tokens, verdict, confidence, support, rarest) from rows (tokens, label).

    Equal rows count each; only tokens in at least ``min_support`` of the rows are mined. Without rows there are no rules.
    """
    sets = stored(labelled.groupBy("tokens", "label").agg(F.count("*").alias("n")), "url-sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    least = max(2, round(min_support * total))
    counts = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    names = [r.token for r in sorted(bounded_rows(counts, MOST_TOKENS), key=lambda r: (-r.n, r.token))]
    place = {t: i for i, t in enumerate(names)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(place[t] for t in own if t in place) for own in batch.column("tokens").to_pylist()]
            each = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            yield pa.record_batch({"token": pa.array([t for r in rows for t in r], pa.int32()),
                                   "others": pa.array([r[:i] for r in rows for i in range(len(r))], pa.list_(pa.int32())),
                                   "label": batch.column("label").take(each), "n": batch.column("n").take(each)})

    dealt = (sets.mapInArrow(deal, "token int, others array<int>, label string, n long")
             .groupBy("token", "others", "label").agg(F.sum("n").alias("n")))

    def mine(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rarest, coded = group.column("token")[0].as_py(), group.column("label").combine_chunks().dictionary_encode()
        labels, of = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        others = group.column("others").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int64)
        flat = np.array([t for x in others for t in x], np.int64)
        out = []
        for body, counts, under in _grown(flat, bounds, of, np.asarray(group.column("n")), least):
            whole = int(counts.sum())
            sure = [labels[i] for i, c in enumerate(counts.tolist()) if c >= least and c / whole >= min_confidence
                    and all(c * int(u.sum()) > int(u[i]) * whole for u in under)]
            out.append({"tokens": sorted([names[rarest], *(names[t] for t in body)]), "rest": sorted(names[t] for t in body),
                        "rarest": names[rarest], "body": whole, "sure": sure,
                        "counts": [(x, c) for x, c in zip(labels, counts.tolist()) if c]})
        return pa.Table.from_pylist(out, schema)

    strings = pa.list_(pa.string())
    schema = pa.schema([("tokens", strings), ("rest", strings), ("rarest", pa.string()), ("body", pa.int64()), ("sure", strings),
                        ("counts", pa.map_(pa.string(), pa.int64()))])
    grown = stored(dealt.groupBy("token").applyInArrow(
        mine, "tokens array<string>, rest array<string>, rarest string, body long, sure array<string>, counts map<string,long>"), "url-bodies")
    # the subset without the rarest token is another task's; where that did not give it, it says no less
    under = grown.select(F.col("tokens").alias("rest"), F.col("body").alias("rest_body"), F.col("counts").alias("rest_counts"))
    found = grown.select("tokens", "rest", "rarest", "body", "counts", F.explode("sure").alias("verdict"))
    found = found.withColumn("support", F.col("counts")[F.col("verdict")])
    longer = (found.where(F.size("rest") > 0).join(under, "rest")
              .where(F.col("support") * F.col("rest_body") > F.coalesce(F.col("rest_counts")[F.col("verdict")], F.lit(0)) * F.col("body")))
    columns = ["tokens", "verdict", (F.col("support") / F.col("body")).alias("confidence"), "support", "rarest"]
    return stored(found.where(F.size("rest") == 0).select(*columns).unionByName(longer.select(*columns)), "url-rules")


def mined_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> list[dict]:
    """The rules of ``rule_table`` on the driver, the surest and shortest first: for tables that give few."""
    rows = rule_table(labelled, min_support, min_confidence).toArrow().to_pylist()
    return sorted(rows, key=lambda r: (-r["confidence"], len(r["tokens"]), -r["support"], r["tokens"], r["verdict"]))


def matcher(rules: list[dict]) -> dict[str, list[tuple[tuple, dict]]]:
    """The inverted index: rules under their rarest token, the best first."""
    index: dict[str, list[tuple[tuple, dict]]] = {}
    for r in rules:
        index.setdefault(r["rarest"], []).append(((-r["confidence"], -r["support"], -len(r["tokens"]), r["tokens"], r["verdict"]), r))
    for held in index.values():
        held.sort(key=lambda x: x[0])
    return index


def best_rule(own: list[str], index: dict) -> dict | None:
    """The surest rule of which a url has all tokens; ties go to the larger support, then the more tokens."""
    held, best = set(own), None
    for t in own:
        for key, r in index.get(t, ()):
            if best is not None and key >= best[0]:
                break
            if held.issuperset(r["tokens"]):
                best = (key, r)
                break
    return best[1] if best else None


def best_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored (held, said, confidence, body): of each distinct ``tokens`` that a rule fits, the rule as by ``best_rule``."""
    held = rows.select(F.col("tokens").alias("held")).distinct()
    looked = held.select("held", F.explode("held").alias("token"))
    fits = looked.join(rules, F.col("token") == F.col("rarest")).where(F.size(F.array_except("tokens", "held")) == 0)
    best = fits.groupBy("held").agg(F.min(F.struct((-F.col("confidence")).alias("unsure"), (-F.col("support")).alias("rare"),
                                                   (-F.size("tokens")).alias("short"), "tokens", "verdict")).alias("r"))
    return stored(best.select("held", F.col("r.verdict").alias("said"), (-F.col("r.unsure")).alias("confidence"),
                              F.col("r.tokens").alias("body")), "url-best")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None,
          min_support: float = 0.002, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every url.

    The verdict is that of the longest given rule that fits, else of the surest mined rule, else
    ``default``. Rules are mined from ``labels`` (url, label); without it, from the urls that given
    rules decide. A null url, or one without ://, has an empty host and path and gets ``default``.
    Repeated rows and null ids stay; an empty table gives no rows; extra columns are not read.
    """
    name, way = host(F.col("url")), path(F.col("url"))
    rule, verdict = given_rule(rules, name, way)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    told = with_tokens(rows.select("page_id", name.alias("host"), way.alias("path"), rule.alias("rule"), verdict.alias("given"), "url"))
    if labels is None:
        learned = told.where(F.col("given").isNotNull()).select("tokens", F.col("given").alias("label"))
    else:
        learned = with_tokens(labels.where("label IS NOT NULL").select("url", "label")).select("tokens", "label")
    found = best_rules(told.where(F.col("given").isNull()), rule_table(learned, min_support, min_confidence))
    judged = told.join(found, (F.col("tokens") == F.col("held")) & F.col("given").isNull(), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", "said", F.lit(default)).alias("verdict"),
                         F.array_join("body", " ").alias("mined"), "confidence")
