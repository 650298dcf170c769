"""Packing documents into training sequences: shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of at most ``max_tokens`` ids. The histogram of piece
lengths has at most ``max_tokens`` bins, whatever the corpus holds, so the driver places it alone:
lengths go longest first, each into the pack that is shortest so far (has most room left), and
packs alike are kept as one pattern with a count. The patterns are joined back to the pieces by
rank: the r-th piece of a length takes the r-th place that the patterns have for this length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from .chunks import RUN_STEP, Memo, coded_runs
from .tables import gather, ragged_take, stored, text_steps

#: Pieces of one length that are ranked in one task; longer bins are split into parts of this size.
PART_ROWS = 20_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Memo:
    """Ids of words by the tokenizer file at ``path``: one for all tasks of a worker process, which share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    return Memo(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])


#: Marks that the tokenizer splits off a word before them.
MARKS = ".,;:!?"


def _words(runs: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Runs without their closing marks, and these; not split unless the marks follow an ASCII letter or digit."""
    bare = pc.utf8_rtrim(runs, MARKS)
    split = pc.match_substring_regex(bare, "[0-9A-Za-z]$")
    marks = pc.struct_field(pc.extract_regex(runs, f"(?P<m>[{MARKS}]*)$"), "m")
    return pc.if_else(split, bare, runs), pc.if_else(split, marks, "")


def _folded(distinct: pa.Array) -> pa.Array:
    """Runs in lower case where that is what the tokenizer makes of them: pure ASCII, without its special tokens."""
    plain = pc.and_not(pc.string_is_ascii(distinct), pc.match_substring(distinct, "<|"))
    return pc.if_else(plain, pc.ascii_lower(distinct), distinct)


def token_ids(texts: pa.Array, memo: Memo, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids, each document's followed by ``end_id``, and the bounds of the documents.

    The tokenizer lower-cases, drops white space and starts a new word at closing marks, so runs
    that differ in case or marks share their words. It composes before it lower-cases, so other than
    ASCII runs keep their case (as do those with its special tokens).
    """
    texts = pc.replace_substring(texts.cast(pa.large_string()), "\n", " ")
    bounds, codes, distinct = coded_runs(texts, _folded)
    parts, ids, held = [], [], 0
    for column in _words(distinct):
        coded = column.dictionary_encode()
        found, n = memo.ids(coded.dictionary.to_pylist())
        at = np.asarray(coded.indices)
        parts.append(((np.cumsum(n) - n + held)[at], n[at]))
        ids.append(found)
        held += len(found)
    # each distinct run's ids: those of its word, then of its marks
    counts = parts[0][1] + parts[1][1]
    ids = gather(np.concatenate(ids), np.column_stack([p[0] for p in parts]).ravel(), np.column_stack([p[1] for p in parts]).ravel())
    starts = np.cumsum(counts) - counts
    flat = gather(ids, starts[codes], counts[codes])
    ends = np.concatenate([[0], np.cumsum(counts[codes])])[bounds]
    return np.insert(flat, ends[1:], end_id), ends + np.arange(len(ends))


def pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    A document of over ``max_tokens`` ids is cut into full pieces and a rest. A null or empty text
    is one piece that holds ``end_id`` alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokenizer(tokenizer_path)
        for batch in batches:
            for part in text_steps(batch, "text", RUN_STEP):
                ids, bounds = token_ids(part.column("text"), memo, end_id)
                n = np.diff(bounds)
                per = -(-n // max_tokens)
                rows = np.repeat(np.arange(len(n)), per)
                start = ragged_take(np.zeros(len(n), np.int64), per) * max_tokens
                length = np.minimum(max_tokens, n[rows] - start)
                raw, at = ids.astype("<u4"), bounds[rows] + start
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(at.tolist(), (at + length).tolist())]
                out = {"doc_id": part.column("doc_id").take(pa.array(rows)), "start": pa.array(start),
                       "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[rows])}
                if with_ids:
                    cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
                yield pa.record_batch(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths): packs of at most ``size`` that hold the histogram, like packs as one pattern."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the space left
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if count:
            (room.setdefault(space, []) if space else done).append((count, lengths))

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            space = max(room, default=0)
            if space < length:  # no pack has room: new ones take as many of this length as fit
                each = size // length
                put(size - each * length, left // each, (length,) * each)
                put(size - left % each * length, int(left % each > 0), (length,) * (left % each))
                break
            count, lengths = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(left, count)
            put(space, count - used, lengths)
            put(space - length, used, lengths + (length,))
            left -= used
    return done + [x for packs in room.values() for x in packs]


def places(found: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """The places of each length, in order of (length, rank): first rank, first sequence, offset."""
    rows, first, taken = [], 0, {}
    for count, lengths in found:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, first, offset))
            taken[length] = rank + count
            offset += length
        first += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def assign(cut_docs: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, start, length, ids_crc32, and any others).

    Pieces alike (repeated rows) take different places. The pieces are read twice: pass a stored table.
    """
    histogram = {r.length: r.n for r in bounded_rows(cut_docs.groupBy("length").agg(F.count("*").alias("n")), max_tokens)}
    at = places(patterns(histogram, max_tokens))
    parts = [max(1, -(-histogram.get(i + 1, 0) // PART_ROWS)) for i in range(max_tokens)]
    part = F.pmod(F.xxhash64("doc_id", "start"), F.element_at(F.lit(parts), F.col("length").cast("int"))).cast("int")
    split = cut_docs.withColumn("_part", part)
    counts = split.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = (split.withColumn("_row", F.row_number().over(
        Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")))
        .join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1))
    shift = np.int64(1 << 48)
    keys = at["length"] * shift + at["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            i = np.searchsorted(keys, length * shift + rank, side="right") - 1
            yield batch.append_column("sequence_id", pa.array(at["sequence"][i] + rank - at["rank"][i])) \
                .append_column("offset", pa.array(at["offset"][i]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
    return placed.select(*cut_docs.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs every document: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset.

    Each id (``end_id`` after each document included) is in exactly one piece; offsets are gapless
    from 0 in each sequence. Null texts count as empty, repeated rows and null ids are packed like
    any other, an empty table gives no rows. Extra columns are not read. ``with_ids`` adds the ids.
    """
    cut_docs = stored(pieces(docs, tokenizer_path, max_tokens, end_id, id_col, text_col, with_ids), "pieces")
    return assign(cut_docs, max_tokens)
