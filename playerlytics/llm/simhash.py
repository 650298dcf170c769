"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's 64-bit fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Two fingerprints within ``max_bits`` bits have at most ``max_bits // 2`` differing bits in one of
their two 32-bit halves. Every distinct fingerprint emits, for either half, all variants within
half of that radius (rounded up); two halves within the radius then share a variant. The variants
are shuffled, colliding fingerprints are verified on all 64 bits, and each variant's members give
a spanning forest of their links, never all pairs. Copies meet once: only distinct fingerprints
are shuffled. Components of the links give each document its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import cut, run_bounds, text_steps

SEED = 42


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of ``shingle`` words, repeats included (fewer words: one; none: none)."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - k + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half of ``hashes`` have a 1."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 8192):
        ones += np.unpackbits(raw[at:at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. A null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_steps(batch, "text"):
                fps = [majority_bits(shingle_hashes(t.as_buffer().to_pybytes(), shingle)) if t.is_valid else 0
                       for t in part.column("text")]
                yield pa.record_batch({"doc_id": part.column("doc_id"),
                                       "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def half_masks(max_bits: int) -> list[int]:
    """The flips of one half that every fingerprint emits: all within half of the radius of a half."""
    flips = (max_bits // 2 + 1) // 2
    return [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(32), k)]


def variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): key is a variant of the low or the high half (bit 32 tells which)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("half"))
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in half_masks(max_bits)]))
    return halves.select("fp", "half", masks.alias("mask")).select(F.expr("half ^ mask").alias("key"), "fp")


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the members within ``max_bits`` of each other: each found once, from a neighbour."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                yield np.full(len(found), node), found


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links of each key's members; rows come sorted by key, and a key may span batches."""
    left_key, left_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        bounds = run_bounds(keys)
        sizes = np.diff(bounds)
        pair = bounds[:-1][sizes == 2]
        a, b = fps[pair], fps[pair + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        found = [(a[near], b[near])]
        for i, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
            found += _forest(fps[i:i + n], max_bits)
        a, b = (np.concatenate(x).astype(np.uint64).view(np.int64) for x in zip(*found))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    for batch in batches:
        keys = np.concatenate([left_key, np.asarray(batch.column("key"))])
        fps = np.concatenate([left_fp, np.asarray(batch.column("fp")).view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield of(keys[:last], fps[:last])
        left_key, left_fp = keys[last:], fps[last:]
    if len(left_key):
        yield of(left_key, left_fp)


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all within ``max_bits`` bits of each other.

    Every pair within the distance is connected through such links; pairs that others of the same
    variant already connect are left out. ``fps`` has one row per fingerprint (column fp).
    """
    spread = variants(fps, max_bits).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(lambda batches: _links(batches, max_bits), "a long, b long").distinct()


def classes(docs_fp: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root, component_id): the smallest fingerprint and doc_id that each distinct fingerprint reaches.

    ``docs_fp`` has doc_id and fp; null ids give way to others (null only if all are).
    """
    least = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("fp"), max_bits))
    rooted = (least.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest doc_id reachable).

    Null and word-less texts have fingerprint zero and link like any other. Repeated rows stay
    repeated. A null doc_id is kept; it names a class only if no other id is in it. Extra columns
    are not read. An empty table gives no rows.
    """
    docs_fp = cut(fingerprints(docs, id_col, text_col, shingle))
    return docs_fp.join(classes(docs_fp, max_bits), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with all columns, one of each group of near-duplicates: of the smallest id.

    Where several texts of a group share that id, the one of the smallest fingerprint (then text
    hash) stays; of rows that repeat id and text, any one. A group of null ids keeps one row.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text_hash)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("kept"))
    docs_fp = cut(fingerprints(keyed.select(F.struct("id", "kept").alias("doc_id"), "text"), shingle=shingle)
                  .select(F.col("doc_id.id").alias("doc_id"), "doc_id.kept", "fp"))
    least = docs_fp.join(classes(docs_fp, max_bits), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("root").agg(F.min(F.struct("fp", "kept")).alias("one")).select("one.kept")
    one = Window.partitionBy("kept").orderBy("kept")
    return (keyed.select("row", "kept").join(kept, "kept").withColumn("n", F.row_number().over(one)).where("n = 1")
            .select(*[F.col(f"row.`{c}`") for c in docs.columns]))
