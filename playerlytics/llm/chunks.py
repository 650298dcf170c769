"""Text as runs between blanks, each distinct run of a step handled once (for the tokenizers)."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at once: the more, the fewer distinct runs a byte.
RUN_STEP = 8 << 20
#: Words that a worker remembers between steps, and the longest that it remembers.
MEMO_WORDS, MEMO_CHARS = 400_000, 48


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``coded_runs`` with the distinct runs as strings."""
    bounds, codes, distinct = coded_runs(texts)
    return bounds, codes, distinct.to_pylist()


def coded_runs(texts: pa.Array, alike: Callable[[pa.Array], pa.Array] | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of texts without nulls, split at single blanks: bounds of each text's runs, each run's code, and the distinct runs.

    ``alike`` maps distinct runs to what stands for them; runs that it maps to the same count as one.
    """
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    codes, distinct = coded.indices, coded.dictionary
    if alike:
        coded = alike(distinct).dictionary_encode()
        codes, distinct = coded.indices.take(codes), coded.dictionary
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), np.asarray(codes), distinct


class Memo:
    """Ids of words by ``encode`` (a list of words to lists of ids), remembered for short words.

    Two generations of half ``MEMO_WORDS`` each: when the young one is full it becomes the old one, whose words are
    taken over again as they occur, so that frequent words are never forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode, self.young, self.old = encode, {"": b""}, {}  # ids as 32-bit integers in bytes

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, word after word, and each word's number of ids."""
        if len(self.young) > MEMO_WORDS // 2:
            self.young, self.old = {"": b""}, self.young
        known, old = self.young, self.old
        missing = [w for w in words if w not in known]
        known.update((w, old[w]) for w in missing if w in old)
        new = [w for w in missing if w not in known]
        if new:
            known.update(zip(new, (array("i", x).tobytes() for x in self.encode(new))))
        found = [known[w] for w in words]
        for w in new:
            if len(w) > MEMO_CHARS:
                del known[w]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.int32), counts
