"""Each document beside its successor: fingerprints of the text, of an edited text, and their likeness."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from .sketch import Shingles, bottom, pack, resemblance
from .tables import text_steps


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, lead, doc_id, text), sorted in each partition so that each row's successor follows it.

    Rows are dealt by ranges of descending id, with one shuffle of the texts. The first row of
    each range also goes to the range before it as its last row, marked ``lead``; the first of all
    goes to the last range. Null ids come last; equal ids go by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = rows.select(F.percentile_approx(key, F.lit(shares), F.lit(20 * n))).first()[0]
    cuts = sorted(set(cuts or []))
    # range i (ascending) holds ids over cuts[i - 1] up to cuts[i]; the one before it in descending order is i + 1
    of = F.pandas_udf(lambda ids: ids.map(lambda x: bisect_left(cuts, x)).astype("int32"), "int")
    firsts = bounded_rows(rows.select(key.alias("k")).groupBy(of("k").alias("part")).agg(F.max("k").alias("k")), max(2, n))
    lead_of = {r.k: r.part for r in firsts}
    full = sorted(r.part for r in firsts)
    before = {p: q for p, q in zip(full, full[1:] + full[:1])}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [-(1 << 63) if x is None else x for x in batch.column("doc_id").to_pylist()]
            part = pa.array(np.array([bisect_left(cuts, x) for x in ids], np.int32), pa.int32())
            own = pa.record_batch({"part": part, "lead": pa.array(np.zeros(len(ids), bool)),
                                   "doc_id": batch.column("doc_id"), "text": batch.column("text")})
            yield own
            also = [i for i, x in enumerate(ids) if x in lead_of]
            if also:
                extra = own.take(pa.array(also))
                to = pa.array([before[lead_of[ids[i]]] for i in also], pa.int32())
                yield pa.record_batch({"part": to, "lead": pa.array(np.ones(len(also), bool)),
                                       "doc_id": extra.column("doc_id"), "text": extra.column("text")})

    dealt = rows.mapInArrow(deal, "part int, lead boolean, doc_id long, text string")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "lead", F.desc_nulls_last("doc_id"), "text")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints_beside(docs: DataFrame, shingle: int = 5, k: int = 128, id_col: str = "doc_id", text_col: str = "text",
                        with_text: bool = False) -> DataFrame:
    """Each document's sketch, its edited text's sketch, and their resemblance; one row per document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, in descending id; the last one's next is the first. Columns:
    doc_id, n_chars, edited_sha256, sketch, edited_sketch (binary), near_edited, near_next
    (resemblance with the edited text and with the next document's), and the edited text where
    ``with_text``. A null text is empty; a lone document is its own next; repeated ids follow each
    other by text.
    """
    def out(rows: pa.RecordBatch, shingles: Shingles) -> Iterator[pa.RecordBatch]:
        """Rows up to the last but one, each with the next one as its successor where both are of a part."""
        part, lead = np.asarray(rows.column("part")), np.asarray(rows.column("lead"))
        texts = rows.column("text").to_pylist()
        mine = np.flatnonzero(~lead[:-1] & (part[1:] == part[:-1])).tolist()
        edits = [_edited(texts[i], texts[i + 1]).encode() for i in mine]
        need = sorted({*mine, *(i + 1 for i in mine)})
        sketch = dict(zip(need, (bottom(h, k) for h in shingles.of([texts[i].encode() for i in need])))) if need else {}
        edited = [bottom(h, k) for h in shingles.of(edits)] if edits else []
        found = {
            "doc_id": rows.column("doc_id").take(pa.array(mine, pa.int64())),
            "n_chars": pa.array([len(texts[i]) for i in mine], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            "sketch": pa.array([pack(sketch[i]) for i in mine], pa.binary()),
            "edited_sketch": pa.array([pack(e) for e in edited], pa.binary()),
            "near_edited": pa.array([resemblance(sketch[i], e, k) for i, e in zip(mine, edited)], pa.float64()),
            "near_next": pa.array([resemblance(sketch[i], sketch[i + 1], k) for i in mine], pa.float64())}
        if with_text:
            found["edited_text"] = pa.array([e.decode() for e in edits], pa.string())
        yield pa.record_batch(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held = Shingles(shingle), None
        for batch in batches:
            for step in text_steps(batch, "text", 1 << 20):
                rows = step if held is None else pa.Table.from_batches([held, step]).combine_chunks().to_batches()[0]
                if rows.num_rows > 1:
                    yield from out(rows, shingles)
                held = rows.slice(rows.num_rows - 1)

    schema = ("doc_id long, n_chars long, edited_sha256 string, sketch binary, edited_sketch binary, near_edited double, "
              "near_next double" + ", edited_text string" * with_text)
    return beside_next(docs, id_col, text_col).mapInArrow(run, schema)
