"""Collocations: phrases whose words stand together more often than by chance, counted in HAT-tries.

Texts are split into pieces and words; all counts are per language. A phrase of two to ``longest``
words is a prefix of the window (that many words, cut at the piece's end) at each of its places, so
counting windows counts all phrases. Words rarer than ``least`` end a window, as no phrase that holds one can
be a candidate; tasks test words against a Bloom filter of bounded size, whose false hits only cost time. So do
pairs and then triples of words: their hashes are counted in buckets, in proportion to the places, and those
of a bucket that holds fewer than ``least`` places are rarer themselves.

A task counts windows in a HAT-trie: a shallow trie on word ids (first, then second word) whose
leaves are hash containers from the rest of the window to its count. A container that grows too
large bursts into a node with a container for each next word. When the task holds too many entries,
its largest subtrees are spilled whole, as sorted runs, one for each prefix partition (by the first
two words). The task merges its runs of a partition before it hands them on, and the runs of all tasks are merged
in one task per partition; partitions with more entries than one
task should hold are split by the rest of the window, and their partial counts are added after.

Word ids are 64-bit hashes per language; that no two words share one is checked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playerlytics.functions.bounded import bounded_rows

from .tables import release_memory, stored, string_buffers, text_steps

#: Words of the longest phrase; a window has as many.
LONGEST = 5
#: Entries of a container that bursts, entries that a task holds before it spills, entries merged in one task.
BURST, HELD, MERGED = 20_000, 250_000, 1_000_000
#: Bytes of spilled runs that a task keeps to merge them.
SPILLED = 16 << 20
#: Bytes of text whose words are taken at once.
STEP = 2 << 20
#: Bits of the filter of frequent words, at most (32 MB), and its least bits.
MOST_BITS, LEAST_BITS = 1 << 28, 1 << 20
_SHIFTS = (0, 18, 36)
#: Words of the phrases that end a window where they are rare.
CUTS = (2, 3)
#: Places of a bucket on average, places that a task holds before it sends them, buckets added up in one task.
LOAD, PLACES, BUCKETS = 8, 2_000_000, 1 << 21

_TO_WORDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts without nulls: each word's code, the number of the piece it stands in, and the distinct words' bytes."""
    raw, bounds = string_buffers(texts)
    ended = np.insert(raw, bounds[1:], 10)  # a text's end is a piece's end
    data = np.frombuffer(ended.tobytes().translate(_TO_WORDS), np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    piece = np.cumsum(data == 10)[starts]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths),
                                              [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = packed.dictionary_encode()
    return np.asarray(coded.indices), piece, coded.dictionary


def word_ids(distinct: pa.Array, lang: str, seed: int) -> np.ndarray:
    """64-bit ids of a language's words; 0 stands for no word."""
    own = xxhash.xxh64_intdigest(lang.encode(), seed)
    return np.array([xxhash.xxh64_intdigest(w, own) or 1 for w in distinct.to_pylist()], np.uint64)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Steps of texts of one language (columns lang, text; no nulls)."""
    for batch in batches:
        for part in text_steps(batch, "text", STEP):
            langs = part.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, part.column("text").filter(pa.array(np.asarray(langs.indices) == code))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id (as long) and n of every word of ``docs`` (columns lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches):
            codes, _, distinct = words(texts)
            yield pa.record_batch({
                "lang": pa.array([lang] * len(distinct), pa.string()), "word": distinct.cast(pa.binary()).cast(pa.string()),
                "id": pa.array(word_ids(distinct, lang, seed).view(np.int64)),
                "n": pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))})

    found = docs.mapInArrow(run, "lang string, word string, id long, n long")
    return found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The stored ``word_counts`` under the first seed that gives no two words of a language the same id, and the seed."""
    for seed in range(8):
        counts = stored(word_counts(docs, seed), "words")
        if counts.groupBy("lang", "id").count().where("count > 1").isEmpty():
            return counts, seed
    raise RuntimeError("word ids collide under every seed")


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [(ids >> np.uint64(s)) & np.uint64(size - 1) for s in _SHIFTS]


def word_filter(frequent: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bloom filter over the ids: packed bits, about ten a word and ``most_bits`` at most (beyond: more false hits)."""
    n = bounded_rows(frequent.agg(F.count("*").alias("n")), 1)[0].n
    size = min(most_bits, max(LEAST_BITS, 1 << int(10 * n).bit_length()))
    at = F.explode(F.array(*[F.shiftrightunsigned("id", s).bitwiseAND(F.lit(size - 1)) for s in _SHIFTS]))
    chunk = 1 << 15
    parts = (frequent.select(at.alias("at")).groupBy(F.floor(F.col("at") / chunk).alias("chunk"))
             .agg(F.bitmap_construct_agg(F.col("at") % chunk).alias("bits")))
    out = np.zeros(size // 8, np.uint8)
    for r in bounded_rows(parts, size // chunk):
        out[r.chunk * (chunk // 8):(r.chunk + 1) * (chunk // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    hit = np.ones(len(ids), bool)
    for at in _bits(ids, len(bits) * 8):
        hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def windows(ids: np.ndarray, piece: np.ndarray, cuts: Sequence[tuple[int, int, np.ndarray]] = ()) -> np.ndarray:
    """A row per place where a phrase starts: its ids, zeros after the end of the piece, before an id 0, or before the
    last word of a phrase that ``cuts`` holds to be rare (words, bits of a bucket, filter of the frequent buckets)."""
    out = np.zeros((len(ids), LONGEST), np.uint64)
    out[:, 0] = ids
    alive = ids != 0
    known = [(k, _frequent_starts(ids, piece, k, bits, seen)) for k, bits, seen in cuts]
    for k in range(1, min(LONGEST, len(ids))):
        alive = alive[:-1] & (piece[k:] == piece[:-k]) & (ids[k:] != 0)
        for words_, starts in known:
            if words_ <= k + 1:  # the phrase that ends with the word k places on
                alive &= starts[k + 1 - words_:][:len(alive)]
        out[:-k, k] = np.where(alive, ids[k:], 0)
    return out[(out[:, 0] != 0) & (out[:, 1] != 0)]


def buckets(rows: np.ndarray, bits: int) -> np.ndarray:
    """The bucket, one of 2 ** ``bits``, of each row of ids."""
    return _mixed(rows) >> np.uint64(64 - bits)


def bucket_ids(at: np.ndarray) -> np.ndarray:
    """Buckets as ids for ``word_filter``."""
    return _mixed(at.astype(np.uint64)[:, None])


def _frequent_starts(ids: np.ndarray, piece: np.ndarray, k: int, bits: int, seen: np.ndarray) -> np.ndarray:
    """Whether the ``k`` words from each place (all in one piece) may be a frequent phrase."""
    out = np.zeros(len(ids), bool)
    n = len(ids) - k + 1
    if n > 0:
        whole = piece[k - 1:] == piece[:n]
        for i in range(k):
            whole &= ids[i:n + i] != 0
        at = np.flatnonzero(whole)
        out[at] = passes(bucket_ids(buckets(np.stack([ids[at + i] for i in range(k)], axis=1), bits)), seen)
    return out


class HatTrie:
    """Counts windows: first word -> container, or a burst node: second word -> container.

    A container is a hash table from the rest of the window, as big-endian bytes, to its count.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict[bytes, Counter | dict[bytes, Counter]] = {}
        self.size: Counter = Counter()  # entries under each first word

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        packed = np.ascontiguousarray(rows.astype(">u8"))
        firsts = packed[:, :1].copy().view("V8").ravel()
        rest = packed[:, 1:].copy().view(f"V{8 * (LONGEST - 1)}").ravel().tolist()
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            first = firsts[start].tobytes()
            node = self.root.get(first)
            if node is None:
                node = self.root[first] = Counter()
            if isinstance(node, Counter):
                node.update(rest[start:end])
                self.size[first] = len(node)
                if len(node) > self.burst:
                    self._burst(first, node)
            else:
                seconds = np.flatnonzero(rows[start + 1:end, 1] != rows[start:end - 1, 1]) + start + 1
                for a, b in zip([start, *seconds.tolist()], [*seconds.tolist(), end]):
                    leaf = node.setdefault(rest[a][:8], Counter())
                    before = len(leaf)
                    leaf.update(x[8:] for x in rest[a:b])
                    self.size[first] += len(leaf) - before

    def _burst(self, first: bytes, container: Counter) -> None:
        node: dict[bytes, Counter] = {}
        for key, n in container.items():
            node.setdefault(key[:8], Counter())[key[8:]] = n
        self.root[first] = node

    def entries(self) -> int:
        return self.size.total()

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out whole subtrees, the largest first, until at most ``keep`` entries stay: their windows and counts."""
        keys, counts, left = [], [], self.entries()
        for first, n in self.size.most_common():
            if left <= keep:
                break
            node = self.root.pop(first)
            del self.size[first]
            left -= n
            if isinstance(node, Counter):
                keys += [first + rest for rest in node]
                counts += node.values()
            else:
                for second, leaf in node.items():
                    keys += [first + second + rest for rest in leaf]
                    counts += leaf.values()
        flat = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, LONGEST)
        return flat, np.array(counts, np.int64)


def _mixed(columns: np.ndarray) -> np.ndarray:
    """A hash of each row of ids."""
    h = np.full(len(columns), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns.T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def _ordered(codes: np.ndarray, counts: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of codes in order, and their summed counts."""
    if not len(codes):
        return codes, counts
    bits = max(1, int(n_ids - 1).bit_length())
    if 3 * bits < 63:  # two numbers hold a row
        def key(columns: range) -> np.ndarray:
            out = codes[:, columns[0]].astype(np.int64)
            for k in columns[1:]:
                out <<= bits
                out |= codes[:, k]
            return out
        order = np.lexsort((key(range(2, LONGEST)), key(range(2))))
    else:
        order = np.lexsort([codes[:, k] for k in reversed(range(LONGEST))])
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], np.any(codes[1:] != codes[:-1], axis=1)]))
    return codes[starts], np.add.reduceat(counts, starts)


def _packed(ids: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
    kind = "<u2" if len(ids) <= 1 << 16 else "<u4"
    head = np.array([len(ids), len(codes)], np.int64)
    columns = np.ascontiguousarray(codes.T.astype(kind)).view(np.uint8).reshape(LONGEST, len(codes), int(kind[2]))
    parts = [head, ids, columns.transpose(0, 2, 1), counts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in parts))


def packed_run(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of windows: the ids it holds, its rows as codes of them, column by column (the codes' bytes apart), the counts."""
    ids, codes = np.unique(rows, return_inverse=True)
    return _packed(ids, *_ordered(codes.reshape(rows.shape).astype(np.int32), counts, len(ids)))


def opened_run(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, codes and counts of a run."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n_ids, n = np.frombuffer(raw, np.int64, 2).tolist()
    size = 2 if n_ids <= 1 << 16 else 4
    ids, at = np.frombuffer(raw, np.uint64, n_ids, 16), 16 + 8 * n_ids
    planes = np.frombuffer(raw, np.uint8, LONGEST * n * size, at).reshape(LONGEST, size, n)
    codes = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"<u{size}").reshape(LONGEST, n).T
    return ids, codes, np.frombuffer(raw, np.int64, n, at + LONGEST * n * size)


def unpacked_run(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a run and their counts."""
    ids, codes, counts = opened_run(run)
    return ids[codes], counts


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, codes and counts of several runs as one."""
    ids = np.unique(np.concatenate([opened_run(r)[0] for r in runs]))
    parts = []
    for own, codes, counts in map(opened_run, runs):
        parts.append((np.searchsorted(ids, own).astype(np.int32)[codes], counts))
    return ids, *_ordered(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]), len(ids))


_RUNS = "lang string, part int, split int, entries long, run binary"


def _dealt(rows: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed run of the rows of each value of ``part``."""
    order = np.argsort(part, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        yield int(part[group[0]]), packed_run(rows[group], counts[group])


def _run_batch(found: list[tuple[str, int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    names = ("lang", "part", "split", "entries", "run")
    return pa.record_batch({n: pa.array([f[i] for f in found], k) for i, (n, k) in enumerate(zip(names, kinds))})


def sent_filter(docs: DataFrame, bits: np.ndarray) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(bits.tobytes())  # MOST_BITS / 8 bytes at most


def _kept_cuts(cuts: Sequence[tuple[int, int, Broadcast]]) -> list[tuple[int, int, np.ndarray]]:
    return [(k, bits, np.frombuffer(sent.value, np.uint8)) for k, bits, sent in cuts]


def packed_buckets(at: np.ndarray) -> bytes:
    """Buckets, in any order, as the gaps between the distinct ones in order and their counts less 1 (bytes apart)."""
    distinct, n = np.unique(at, return_counts=True)
    numbers = np.stack([np.diff(distinct, prepend=np.uint64(0)).astype("<u4"), (n - 1).astype("<u4")])
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(2, len(distinct), 4).transpose(0, 2, 1))
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def opened_buckets(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a run and their counts."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(run), np.uint8).reshape(2, 4, -1)
    gaps, n = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
    return np.cumsum(gaps), n + 1


def frequent_buckets(docs: DataFrame, sent: Broadcast, seed: int, cuts: Sequence[tuple[int, int, Broadcast]], k: int, bits: int,
                     least: int, parts: int, places: int = PLACES) -> DataFrame:
    """id (``bucket_ids``) and n of the buckets in which at least ``least`` phrases of ``k`` words lie; a bucket's phrases may differ."""
    width = max(1, min(bits, BUCKETS.bit_length() - 1, bits - (parts - 1).bit_length()))  # bits of a bucket within its part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.frombuffer(sent.value, np.uint8), _kept_cuts(cuts)
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            at = np.sort(np.concatenate(held))
            held.clear()
            part = (at >> np.uint64(width)).astype(np.int64)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            runs = [packed_buckets(x & np.uint64((1 << width) - 1)) for x in np.split(at, starts[1:])]
            return pa.record_batch({"part": pa.array(part[starts].astype(np.int32)), "run": pa.array(runs, pa.binary())})

        for lang, texts in by_language(batches):
            codes, piece, distinct = words(texts)
            if not len(codes):
                continue
            ids = word_ids(distinct, lang, seed)
            ids[~passes(ids, seen)] = 0
            rows = windows(ids[codes], piece, own)
            held.append(buckets(rows[rows[:, k - 1] != 0, :k], bits))
            if sum(map(len, held)) > places:
                yield packed()
        if sum(map(len, held)):
            yield packed()
        release_memory()

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << width, np.int64)
        for packed in table.column("run").to_pylist():
            at, n = opened_buckets(packed)
            total[at] += n
        at = np.flatnonzero(total >= least)
        ids = bucket_ids(at + (key[0].as_py() << width))
        return pa.table({"id": pa.array(ids.view(np.int64)), "n": pa.array(total[at])})

    return docs.mapInArrow(run, "part int, run binary").groupBy("part").applyInArrow(added, "id long, n long")


def rare_cuts(docs: DataFrame, sent: Broadcast, seed: int, places: int, least: int, parts: int) -> list[tuple[int, int, Broadcast]]:
    """The ``cuts`` of ``windows``, filters sent to the tasks, for texts with ``places`` frequent words."""
    cuts: list[tuple[int, int, Broadcast]] = []
    for k in CUTS:
        bits = min(48, max(12, (places // LOAD).bit_length()))
        found = stored(frequent_buckets(docs, sent, seed, cuts, k, bits, least, parts), f"buckets-{k}")
        cuts.append((k, bits, docs.sparkSession.sparkContext.broadcast(word_filter(found).tobytes())))
        places = bounded_rows(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), 1)[0].n
    return cuts


def spilled_runs(docs: DataFrame, bits: np.ndarray | Broadcast, seed: int, parts: int, held: int = HELD, burst: int = BURST,
                 cuts: Sequence[tuple[int, int, Broadcast]] = ()) -> DataFrame:
    """The sorted runs of all tasks' HAT-tries: lang, part (prefix partition), split (0), entries, run."""
    sent = sent_filter(docs, bits) if isinstance(bits, np.ndarray) else bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.frombuffer(sent.value, np.uint8), _kept_cuts(cuts)
        tries: dict[str, HatTrie] = {}
        spilled: dict[tuple[str, int], list[bytes]] = {}

        def spill(lang: str, keep: int) -> int:
            rows, counts = tries[lang].spill(keep)
            size = 0
            for part, packed in _dealt(rows, counts, (_mixed(rows[:, :2]) % np.uint64(parts)).astype(np.int64)):
                spilled.setdefault((lang, part), []).append(packed)
                size += len(packed)
            return size

        def merged_runs_so_far() -> Iterator[pa.RecordBatch]:
            for lang, part in list(spilled):
                ids, codes, counts = merged(spilled.pop((lang, part)))
                yield _run_batch([(lang, part, 0, len(codes), _packed(ids, codes, counts))])

        kept = 0
        for lang, texts in by_language(batches):
            codes, piece, distinct = words(texts)
            if not len(codes):
                continue
            ids = word_ids(distinct, lang, seed)
            ids[~passes(ids, seen)] = 0
            rows = windows(ids[codes], piece, own)
            for at in range(0, len(rows), held // 2):
                tries.setdefault(lang, HatTrie(burst)).add(rows[at:at + held // 2])
                while sum(t.entries() for t in tries.values()) > held:
                    largest = max(tries, key=lambda x: tries[x].entries())
                    kept += spill(largest, tries[largest].entries() // 2)
            if kept > SPILLED:
                yield from merged_runs_so_far()
                kept = 0
        for lang in list(tries):
            spill(lang, 0)
            del tries[lang]
        yield from merged_runs_so_far()
        release_memory()

    return docs.mapInArrow(run, _RUNS)


def split_runs(runs: DataFrame, most: int = MERGED) -> DataFrame:
    """Runs of partitions with more than ``most`` entries cut by a hash of the window after its first two words.

    The runs are read twice: pass a stored table.
    """
    # stored, so that its size is known before the join: the runs are not shuffled to meet a small table
    sizes = stored(runs.groupBy("lang", "part").agg(F.sum("entries").alias("all")), "run-sizes")
    cut = runs.join(sizes, ["lang", "part"]).withColumn("ways", F.ceil(F.col("all") / most).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, counts = unpacked_run(row["run"])
                where = (_mixed(rows[:, 2:]) % np.uint64(row["ways"])).astype(np.int64)
                for i, packed in _dealt(rows, counts, where):
                    yield _run_batch([(row["lang"], row["part"], i + 1, int((where == i).sum()), packed)])

    kept = cut.where("ways = 1").select("lang", "part", "split", "entries", "run")
    return kept.unionByName(cut.where("ways > 1").select("lang", "part", "ways", "run").mapInArrow(run, _RUNS))


def merged_runs(runs: DataFrame, least: int) -> DataFrame:
    """lang, ids and n of phrases of two words and more: whole counts of at least ``least``, or partial counts of splits."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, _, split = (k.as_py() for k in key)
        ids, codes, counts = merged(table.column("run").to_pylist())
        found, totals = [], []
        absent = int(ids[0] == 0) if len(ids) else 0  # the code of no word is 0, where there is one
        for k in range(2, LONGEST + 1):
            held = codes[:, k - 1] >= absent
            rows, n = codes[held, :k], counts[held]
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], np.any(rows[1:] != rows[:-1], axis=1)]))
            total = np.add.reduceat(n, starts)
            keep = total >= (1 if split else least)
            found += ids[rows[starts[keep]]].view(np.int64).tolist()
            totals += total[keep].tolist()
        release_memory()
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "ids": pa.array(found, pa.list_(pa.int64())),
                         "n": pa.array(totals, pa.int64())})

    return runs.groupBy("lang", "part", "split").applyInArrow(run, "lang string, ids array<long>, n long")


def phrase_counts(docs: DataFrame, least: int, parts: int | None = None, held: int = HELD, burst: int = BURST,
                  merge: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to five words that occur ``least`` times or more (lang, phrase as an array of words, n), and
    all words (lang, word, id, n), both stored. ``docs`` has the columns lang and text without nulls."""
    parts = parts or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts, seed = counted_words(docs)
    frequent = counts.where(F.col("n") >= least)
    sent = sent_filter(docs, word_filter(frequent))
    places = bounded_rows(frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), 1)[0].n
    cuts = rare_cuts(docs, sent, seed, places, least, parts)
    runs = stored(spilled_runs(docs, sent, seed, parts, held, burst, cuts), "runs")
    partial = merged_runs(split_runs(runs, merge), least)
    phrases = stored(partial.groupBy("lang", "ids").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrase-ids")
    spelled = (phrases.select("lang", "ids", "n", F.posexplode("ids").alias("at", "id"))
               .join(frequent.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "ids", "n").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
               .select("lang", F.col("w.word").alias("phrase"), "n"))
    single = frequent.select("lang", F.array("word").alias("phrase"), "n")
    return stored(single.unionByName(spelled), "phrases"), counts


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), with products of up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    over = (wide[0] * wide[1]).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide[2] * wide[3]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text",
                 **limits) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z. A null text is empty, a null language is ``und``. Repeated rows count as
    often as they occur; an empty table, or one without frequent phrases, gives no rows. Other
    columns are not read. Phrases that only occur inside a longer candidate are dropped. The score is
    that of the cut with the lowest one (the first of those that tie).
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    phrases, words_of = phrase_counts(rows, least, **limits)
    longer = phrases.where(F.size("phrase") > 2)
    inner = F.explode(F.array(F.slice("phrase", F.lit(2), F.size("phrase") - 1), F.slice("phrase", F.lit(1), F.size("phrase") - 1)))
    # an inner phrase is at least as frequent, so one that is not left alone has a longer one by a word that is as frequent
    covered = (longer.select("lang", inner.alias("phrase"), F.col("n").alias("a")).distinct())
    whole = phrases.where(F.size("phrase") > 1).withColumnRenamed("n", "a").join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = F.explode(F.sequence(F.lit(1), F.size("phrase") - 1))
    parts = (whole.select("lang", "phrase", "a", cuts.alias("k"))
             .withColumn("first", F.slice("phrase", F.lit(1), F.col("k")))
             .withColumn("rest", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))))
    scored = (parts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
              .join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
              .join(words_of.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
              .withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
            .select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "b.l", "b.r", "n", "b.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
