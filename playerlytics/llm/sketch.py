"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles (big-endian, ascending).
The sketch of a union is the k smallest of the parts' hashes, so sketches of parts merge exactly.
Resemblance is the share of the k smallest hashes of the union that both sketches hold; distinct
shingles are counted when there are fewer than k, else estimated from the k-th smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import text_steps

#: Multipliers of the hashes (odd).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Hashes of all shingles of many texts at once; the power tables grow with the longest step."""

    def __init__(self, words: int, inside: np.ndarray = ~_SPACE):
        """``inside`` tells for each byte whether it is part of a word."""
        self.words, self.inside, self.up, self.down = words, inside, _powers(BYTE_BASE, 0), _powers(BYTE_BASE, 0)
        self.turn = _powers(WORD_BASE, words)

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word: a polynomial of its lower-cased bytes, the same wherever it stands."""
        if len(raw) + 1 > len(self.up):
            n = 1 << int(len(raw) + 1).bit_length()
            self.up, self.down = _powers(BYTE_BASE, n), _powers(pow(BYTE_BASE, -1, 1 << 64), n)
        inside = np.concatenate([[False], self.inside[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64),
                               np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.up[:len(raw)], dtype=np.uint64)])
        return starts, ends, _mix((sums[ends] - sums[starts]) * self.down[starts])

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The shingle hashes of each text, repeats included; a text of fewer words is one shingle."""
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, _, words = self.word_hashes(raw)
        bounds = np.searchsorted(starts, offsets)
        n = max(0, len(words) - self.words + 1)
        rows = sum((words[j:j + n] * self.turn[j] for j in range(self.words)), np.zeros(n, np.uint64))
        rows = _mix(rows + np.uint64(self.words))
        for i, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - i >= self.words:
                yield rows[i:e - self.words + 1]
            elif e > i:
                yield _mix((words[i:e] * self.turn[:e - i]).sum(keepdims=True, dtype=np.uint64) + np.uint64(e - i))
            else:
                yield rows[:0]


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    hashes = np.sort(hashes)
    if len(hashes):
        hashes = hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
    return hashes[:k]


def pack(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of the distinct shingles of either text that both hold; 1 for two empty sketches."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    new = np.concatenate([[True], both[1:] != both[:-1]])
    first = np.flatnonzero(new)[:k]
    twice = np.concatenate([~new[1:], [False]])[first]
    return float(twice.sum()) / len(first)


def distinct(a: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles (exact below k)."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** 64 / max(float(a[k - 1]), 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of the distinct shingles of the first text that the second holds; 1 if the first has none."""
    if not len(a):
        return 1.0
    union = distinct(bottom(np.concatenate([a, b]), k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, k: int = 128) -> DataFrame:
    """(doc_id, sketch): the bottom-k sketch of each whole text.

    Words are lower-cased (A-Z) and split at ASCII white space; a text of fewer words than
    ``shingle`` is one shingle, a null or word-less text has an empty sketch. Repeated rows and
    null ids stay; an empty table gives no rows; extra columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            for part in text_steps(batch, "text", 1 << 20):
                texts = [t.as_buffer().to_pybytes() for t in part.column("text")]
                yield pa.record_batch({"doc_id": part.column("doc_id"),
                                       "sketch": pa.array([pack(bottom(h, k)) for h in shingles.of(texts)], pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, sketch binary"))


def merged(parts: DataFrame, key: str, k: int = 128) -> DataFrame:
    """(key, sketch): the sketch of all of each key's parts; a key of which all parts are empty has an empty one.

    Hashes are made distinct and cut to the k smallest before each shuffle of them, so a key that
    holds most rows costs each task k hashes.
    """
    hashes = F.expr("transform(sequence(0, greatest(length(sketch) div 8, 1) - 1), "
                    "i -> substring(sketch, i * 8 + 1, 8))")
    one = parts.select(F.col(key).alias("key"), F.explode(hashes).alias("h")).distinct()
    least = Window.partitionBy("key").orderBy("h")
    kept = one.where(F.length("h") > 0).withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k)
    found = kept.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    return (one.select("key").distinct().alias("a").join(found.alias("b"), F.expr("a.key <=> b.key"), "left")
            .select(F.col("a.key").alias(key), F.expr("coalesce(aggregate(b.hs, X'', (s, h) -> concat(s, h)), X'')").alias("sketch")))


def compared(pairs: DataFrame, a: str = "a", b: str = "b", k: int = 128) -> DataFrame:
    """Adds resemblance, containment (of a in b), distinct_a and distinct_b to pairs of sketches (null: empty).

    Columns of these names are replaced, all others stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(unpack(x or b""), unpack(y or b"")) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            for name, f in (("resemblance", lambda x, y: resemblance(x, y, k)), ("containment", lambda x, y: containment(x, y, k)),
                            ("distinct_a", lambda x, y: distinct(x, k)), ("distinct_b", lambda x, y: distinct(y, k))):
                batch = batch.append_column(name, pa.array([f(x, y) for x, y in both], pa.float64()))
            yield batch

    pairs = pairs.drop("resemblance", "containment", "distinct_a", "distinct_b")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, resemblance double, containment double, distinct_a double, distinct_b double")
