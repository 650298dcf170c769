"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

The texts of a step are cut where no piece can reach across; the distinct units are laid end to end
and indexed by a suffix array (sorted to the length of the longest piece). Every piece of the
vocabulary is binary-searched for its range of occurrences; the occurrences are the edges, set in
order of position. Relaxing then applies, in every unit, the edge of the best score that spans two
adjoining symbols, until none is left: the merges of byte-pair encoding, in its order. Characters
that no piece covers become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import runs
from .tables import gather, ragged_take, text_steps

#: Text bytes of a step, characters indexed at once, and the longest unit that is relaxed beside others.
STEP, INDEXED, LONG_UNIT = 8 << 20, 1 << 19, 64
SPACE = "▁"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


class Vocabulary:
    """The pieces, scores and kinds of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        if model.piece_to_id("<0x00>") == model.unk_id():
            raise ValueError("the model has no byte pieces")
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = np.array([model.get_score(i) for i in range(n)], np.float64)
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = np.array(plain, np.int64)
        words = [self.pieces[i] for i in plain]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.longest = int(self.lengths.max())
        self.chars = np.zeros((len(words), self.longest), np.int64)
        self.chars[np.arange(self.longest) < self.lengths[:, None]] = _codes("".join(words))
        inner = np.arange(1, self.longest) < self.lengths[:, None]
        pairs = (self.chars[:, :-1] << 21 | self.chars[:, 1:])[inner]
        self.pairs = np.unique(pairs)  # characters that adjoin in some piece
        if any(SPACE in w.lstrip(SPACE) for w in words):
            raise ValueError("a piece holds a space after other characters")
        # what each id decodes to
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        plain_ids = set(plain)
        raw = [of_byte.get(i) if i in of_byte else w.replace(SPACE, " ").encode() if i in plain_ids else
               " ⁇ ".encode() if model.is_unknown(i) else b"" for i, w in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by their first ``depth`` characters (or more), by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        after = np.concatenate([rank[width:], np.zeros(min(width, len(rank)), np.int64)])[:len(rank)]
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        width *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Range of each piece in the suffix array: binary search, a character at a time, all pieces at once."""
    padded = np.concatenate([text, np.full(vocabulary.longest, -1)])
    low = np.zeros(len(vocabulary.ids), np.int64)
    high = np.full(len(vocabulary.ids), len(text), np.int64)

    def bound(lo: np.ndarray, hi: np.ndarray, j: int, limit: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose character j is ``limit`` or more."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = padded[order[mid] + j] < limit[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    for j in range(vocabulary.longest):
        on = np.flatnonzero((vocabulary.lengths > j) & (low < high))
        c = vocabulary.chars[on, j]
        low[on], high[on] = bound(low[on], high[on], j, c), bound(low[on], high[on], j, c + 1)
    return low, high


def edges(text: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """For each position and length (less 1) the piece that stands there, or -1: all edges in order of position."""
    order = suffix_array(text, vocabulary.longest)
    low, high = occurrences(text, order, vocabulary)
    n = np.maximum(high - low, 0)
    at = order[ragged_take(low, n)]
    out = np.full((len(text), vocabulary.longest), -1, np.int32)
    out[at, np.repeat(vocabulary.lengths - 1, n)] = np.repeat(vocabulary.ids, n)
    return out


def _relax_long(start: int, end: int, table: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
    """Symbols (start, end) of one unit, best edges first from a heap."""
    longest = table.shape[1]
    after = {i: i + 1 for i in range(start, end)}  # symbol start -> its end
    before = {i + 1: i for i in range(start, end)}
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        middle = after[i]
        if middle < end:
            stop = after[middle]
            piece = table[i, stop - i - 1] if stop - i <= longest else -1
            if piece >= 0:
                heapq.heappush(heap, (-scores[piece], i, middle, stop))

    for i in range(start, end):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if after.get(i) != middle or after.get(middle) != stop:
            continue
        after[i], before[stop] = stop, i
        del after[middle], before[middle]
        offer(i)
        if i > start:
            offer(before[i])
    return sorted(after.items())


def relax(bounds: np.ndarray, table: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, length) of all units [bounds[i], bounds[i + 1] - 1), in order; the last place of each is a separator."""
    longest = table.shape[1]
    sizes = np.diff(bounds) - 1
    short = np.flatnonzero(sizes <= LONG_UNIT)
    start = ragged_take(bounds[:-1][short], sizes[short])
    unit = np.repeat(short, sizes[short])
    end = start + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        length = np.append(end[1:], 0) - start
        join = np.append(unit[1:] == unit[:-1], False) & (length <= longest)
        piece = np.where(join, table[start, np.where(join, length - 1, 0)], -1)
        score = np.where(piece >= 0, scores[piece], -np.inf)
        first = run_starts(unit)
        best = np.maximum.reduceat(score, first)
        at_best = np.flatnonzero((score == np.repeat(best, np.diff(np.append(first, len(unit))))) & (piece >= 0))
        if not len(at_best):
            done.append((start, end - start))
            break
        left = at_best[np.concatenate([[True], unit[at_best[1:]] != unit[at_best[:-1]]])]  # leftmost of each unit
        live = np.repeat(best > -np.inf, np.diff(np.append(first, len(unit))))
        if not live.all():
            done.append((start[~live], (end - start)[~live]))
        end[left] = end[left + 1]
        live[left + 1] = False
        start, end, unit = start[live], end[live], unit[live]
    for i in np.flatnonzero(sizes > LONG_UNIT).tolist():
        found = np.array(_relax_long(int(bounds[i]), int(bounds[i + 1]) - 1, table, scores), np.int64)
        done.append((found[:, 0], found[:, 1] - found[:, 0]))
    starts = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
    lengths = np.concatenate([n for _, n in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    return starts[order], lengths[order]


def run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)

    def _indexed(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of ``text`` (each ends with a separator), and the number of each unit's ids."""
        v = self.vocabulary
        table = edges(text, v)
        start, length = relax(bounds, table, v.scores)
        piece = table[start, length - 1].astype(np.int64)
        unit = np.searchsorted(bounds, start, side="right") - 1
        extra, chars = [np.arange(len(v.pieces))], np.unique(text[start[piece < 0]])
        spelled = [v.bytes[list(chr(c).encode())] for c in chars.tolist()]
        first = len(v.pieces) + np.cumsum([0] + [len(x) for x in spelled])
        at, n = piece.copy(), np.ones(len(piece), np.int64)
        which = np.searchsorted(chars, text[start[piece < 0]])
        at[piece < 0], n[piece < 0] = first[which], np.diff(first)[which]
        ids = np.concatenate(extra + spelled)[ragged_take(at, n)]
        return ids, np.bincount(unit, n, len(bounds) - 1).astype(np.int64)

    def units(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings (spaces as SPACE), one after the other, and the number of each one's ids.

        Strings are cut between characters that adjoin in no piece; each distinct cut is indexed once.
        """
        v = self.vocabulary
        joined = "".join(distinct)
        text = _codes(joined)
        ends = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct)))
        cut = np.ones(len(text) + 1, bool)
        if len(text):
            cut[1:-1] = False
            cut[ends] = True
            pair = text[:-1] << 21 | text[1:]
            i = np.minimum(np.searchsorted(v.pairs, pair), max(0, len(v.pairs) - 1))
            cut[1:-1] |= v.pairs[i] != pair
        at = np.flatnonzero(cut)
        words = pa.array([joined[i:e] for i, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.large_string()).dictionary_encode()
        cuts = words.dictionary.to_pylist()
        del text
        ids, counts = [], []
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts)) + 1
        total = np.cumsum(sizes)
        i = 0
        while i < len(cuts):
            e = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + INDEXED)))
            bounds = np.concatenate([[0], np.cumsum(sizes[i:e])])
            part = _codes("\0".join(cuts[i:e]) + "\0")
            part[bounds[1:] - 1] = -1  # separators, which are in no piece
            found, n = self._indexed(part, bounds)
            ids.append(found)
            counts.append(n)
            i = e
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        which = np.asarray(words.indices)
        starts = np.cumsum(counts) - counts
        flat = gather(ids, starts[which], counts[which])
        of = np.concatenate([[0], np.cumsum(counts[which])])[np.searchsorted(at, np.concatenate([[0], ends]))]
        return flat, np.diff(of)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without nulls, and the bounds of each text's ids."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), SPACE, " ")
        bounds, codes, distinct = runs(texts)
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        empty = np.array([not d for d in distinct], bool)[codes] if len(distinct) else np.zeros(0, bool)
        # a unit is a run and the blanks before it; blanks at the end are a unit of their own
        last = np.zeros(len(codes), bool)
        last[bounds[1:] - 1] = True
        takes = np.flatnonzero(~empty | last)
        before = np.concatenate([[-1], takes[:-1]])
        before = np.maximum(before, bounds[rows[takes]] - 1)
        blanks = takes - before - 1 + ~empty[takes]
        blanks = np.where(empty[takes], takes - before, blanks)
        blank_text = np.asarray(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        used = ~blank_text[rows[takes]]
        takes, blanks = takes[used], blanks[used]
        most = int(blanks.max(initial=0)) + 1
        keys, which = np.unique(codes[takes] * most + blanks, return_inverse=True)
        ids, counts = self.units([SPACE * int(k % most) + distinct[int(k // most)] for k in keys.tolist()])
        starts = np.cumsum(counts) - counts
        flat = gather(ids, starts[which], counts[which])
        per = np.bincount(rows[takes], counts[which], len(texts)).astype(np.int64)
        return flat.astype(np.int32), np.concatenate([[0], np.cumsum(per)])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids; the blank that encoding puts first goes, wrong bytes become U+FFFD."""
        v = self.vocabulary
        n = v.raw_lengths[ids]
        raw = gather(v.raw, v.raw_starts[ids], n).tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
        out = []
        for i, e in zip(at[:-1], at[1:]):
            part = raw[i:e]
            out.append((part[1:] if part[:1] == b" " else part).decode(errors="replace"))
        return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(doc_id, ids) of every whole text, as the model's own encoder gives them.

    With ``check`` also decoded_sha256 of the text that the ids decode to, and round_trip, whether
    it is the text (a text that holds U+2581 itself comes back with blanks). A null or empty text
    has no ids. Repeated rows and null ids stay; an empty table gives no rows; extra columns are
    not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for batch in batches:
            for part in text_steps(batch, "text", STEP):
                ids, bounds = encoder.encode(part.column("text"))
                out = {"doc_id": part.column("doc_id"),
                       "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))}
                if check:
                    texts = encoder.decode(ids, bounds)
                    out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
                    out["round_trip"] = pa.array([a == b for a, b in zip(texts, part.column("text").to_pylist())], pa.bool_())
                yield pa.record_batch(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded_sha256 string, round_trip boolean" * check))


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids; null ids and null elements count as none, ids outside the vocabulary as <unk>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        size = len(encoder.vocabulary.pieces)
        for batch in batches:
            flat = np.asarray(batch.column("ids").flatten(), np.int64)
            n = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = encoder.decode(np.where((flat >= 0) & (flat < size), flat, 0), np.concatenate([[0], np.cumsum(n)]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    kind = rows.schema[id_col].dataType.simpleString()
    ids = F.coalesce(F.filter(F.col(ids_col).cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>"))
    return rows.select(F.col(id_col).alias("doc_id"), ids.alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
