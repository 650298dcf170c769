"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Vectors are integers (``floor(scale * x)``). The rows are dealt into blocks; each block holds, per
dimension, its postings in segments of equal quantised value. For a query, a segment's impact is
the most that it can add over the dimension's least contribution. Segments are processed by
descending impact, adding the least contribution of the segment to its rows' accumulators. A row's
bound is its accumulator, the quantisation error, and the impact of the next segment of every
dimension where the row is not yet seen. Processing stops only when all rows but a few are proven
to miss the k best lower bounds; those few are rescored exactly. Queries stream past each block
after its postings, so that a task holds one block and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import run_bounds

#: Rows of an index block, and quantised values of a dimension.
BLOCK_ROWS, LEVELS = 8192, 64
#: A proof is tried when all segments with more than this share of the greatest impact are processed.
SHARES = (1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32, 0)


class Block:
    """The index of one block: ids and integer vectors (missing trailing components are zero)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.columns = np.ascontiguousarray(vectors.T)
        self.order = np.argsort(self.columns, axis=1, kind="stable")  # of a dimension: rows by value
        width = max(1, -(-int(vectors.max(initial=0) - vectors.min(initial=0) + 1) // LEVELS))
        self.segments = []  # of a dimension: bounds in its order, smallest and largest value of each
        for values, order in zip(self.columns, self.order):
            values = values[order]
            bounds = run_bounds(values // width)
            self.segments.append((bounds, values[bounds[:-1]], values[bounds[1:] - 1]))

    def _bounds(self, work: list, done: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Of each row, the most that the dimensions add in which it is not yet seen."""
        most = np.zeros(len(self.ids), np.int64)
        for (d, up, bounds, _, _), to, impact in zip(work, done.tolist(), ahead.tolist()):
            if impact and to:
                last = self.columns[d][self.order[d][bounds[to] if up else bounds[to] - 1]]
                unseen = self.columns[d] < last if up else self.columns[d] > last
                most += impact * unseen
            else:
                most += impact
        return most

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows for ``q`` but those with id ``own``."""
        dims = self.x.shape[1]
        q = np.concatenate([q, np.zeros(max(0, dims - len(q)), np.int64)])[:dims]
        mine = self.ids != own
        work, error = [], 0
        for d in np.flatnonzero(q).tolist():
            bounds, low, high = self.segments[d]
            up = bool(q[d] > 0)
            least, most = (q[d] * low, q[d] * high) if up else (q[d] * high, q[d] * low)
            if up:  # by descending impact: from the end
                bounds, least, most = bounds[::-1], least[::-1], most[::-1]
            error += int((most - least).max())
            work.append((d, up, bounds, least - least.min(), most - least.min()))
        acc = np.where(mine, 0, np.iinfo(np.int64).min // 2)
        done = np.zeros(len(work), np.int64)
        ahead = np.array([w[4][0] for w in work], np.int64)
        top, possible = int(ahead.max(initial=0)), mine
        for share in SHARES if len(acc) > 4 * k else ():
            for j, (d, up, bounds, least, most) in enumerate(work):
                to = int(np.count_nonzero(most > share * top)) if share else len(most)
                if to > done[j]:
                    i, e = bounds[done[j]], bounds[to]
                    gain = np.repeat(least[done[j]:to], np.abs(np.diff(bounds[done[j]:to + 1])))
                    if up:
                        acc[self.order[d][e:i]] += gain[::-1]
                    else:
                        acc[self.order[d][i:e]] += gain
                    done[j] = to
                ahead[j] = most[to] if to < len(most) else 0
            bar = np.partition(acc, len(acc) - k)[len(acc) - k]
            if share and bar - np.median(acc) < ahead.sum() // 4:
                continue  # most rows are still in reach: no proof yet
            possible = mine & (acc + self._bounds(work, done, ahead) + error >= bar)
            if np.count_nonzero(possible) <= max(4 * k, len(acc) // 8):
                break  # proven: no other row reaches the k best
        rows = np.flatnonzero(possible)
        scores = self.x[rows] @ q
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def _matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    lists = [np.asarray(x, np.int64) for x in column.to_pylist()]
    out = np.zeros((len(lists), dims or max(map(len, lists), default=0)), np.int64)
    for row, x in zip(out, lists):
        row[:len(x)] = x[:len(row)]
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, a block's own rows before the queries."""
    at, rows, index = None, [], None
    for batch in batches:
        block, is_query = np.asarray(batch.column("block")), np.asarray(batch.column("is_query"))
        starts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])) + 1,
                                 [len(block)]]) if len(block) else []
        for i, e in zip(starts[:-1], starts[1:]):
            if block[i] != at:
                at, rows, index = block[i], [], None
            part = batch.slice(i, e - i)
            if not is_query[i]:
                rows.append(part)
                continue
            if index is None and rows:
                held = pa.Table.from_batches(rows).combine_chunks()
                index = Block(np.asarray(held.column("vec_id")), _matrix(held.column("v")))
                rows = []
            if index is None:
                continue
            found = [(own, *index.search(own, np.asarray(q, np.int64), k))
                     for own, q in zip(part.column("vec_id").to_pylist(), part.column("v").to_pylist())]
            yield pa.record_batch({
                "query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                "vec_id": pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                "score": pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))})


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows with a null or non-finite one are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v")))


def search(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for each row where ``is_query``.

    ``is_query`` is a condition on the id column. A query never finds rows of its own id. Ties go
    to the smaller id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. Shorter vectors count as ending in zeros. Repeated rows are
    candidates each; a repeated query id is asked once, with its smallest vector. With no query or
    no other row there are no rows. Scores are exact while they fit a long. Extra columns are not read.
    """
    asked = df.where(is_query)
    vectors = integer_vectors(df, id_col, vector_col, scale)
    blocks = max(1, -(-vectors.count() // block_rows))
    held = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.lit(False).alias("is_query"),
                          "vec_id", "v")
    queries = (integer_vectors(asked, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
               .select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                       F.lit(True).alias("is_query"), "vec_id", "v"))
    found = (held.unionByName(queries).repartition("block").sortWithinPartitions("block", "is_query")
             .mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
