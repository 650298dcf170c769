"""Spans (kind, start, end) in code points found in whole texts, and what queries derive from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import text_steps

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def in_order(spans: list[Span], kinds: list[str]) -> list[dict]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))]


def scan(docs: DataFrame, find: Callable[[str], list[Span]], kinds: list[str], id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every whole text (null: empty), spans by start, then kind as in ``kinds``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                found = [in_order(find(t), kinds) for t in part.column("text").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "spans": pa.array(found, ARROW_SPANS)})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, spans {SPANS}"))


def of_kinds(kinds: list[str], column: str = "spans") -> Column:
    return F.filter(column, lambda s: s["kind"].isin(kinds))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(found: DataFrame, base: list[str]) -> DataFrame:
    """The columns of a contract: doc_id, n_<kind> of the base kinds, base_sha256, spans (a string)."""
    return found.select("doc_id", *[F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(joined(of_kinds(base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
