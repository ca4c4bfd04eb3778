"""Exact top-k search by inner product, as tiled matrix products.

Queries come in blocks of bounded size; a block is sent to all tasks, which
multiply it with their rows a tile at a time, keep each query's best rows of the
tile, and emit the best of their share. The lists are merged in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile, queries multiplied with it at once, queries sent together.
TILE, ROWS, BLOCK = 4096, 512, 8192
#: Partial lists that the first merge brings together, at least.
BRANCHES = 16
_LOW = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, x): each component as floor(scale * component); incomplete vectors are left out."""
    usable = F.forall(
        vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    named = rows.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & usable)
    floors = F.transform(vector_column, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return named.select(F.col(id_column).cast("long").alias("id"), floors.alias("x"))


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list array; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class _Best:
    """The best rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.score = np.full((len(ids), k), _LOW)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in a tile, sorted by id."""
        width = max(x.shape[1], self.x.shape[1])
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        mine = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1])))
        # Below 2^53 sums of doubles are exact; beyond it integers are.
        exact = np.abs(x).max(initial=0) * np.abs(mine).max(initial=0) * max(width, 1) < 2.0**53
        if not exact:
            x, mine = x.astype(np.int64), mine.astype(np.int64)
        first, last = np.searchsorted(ids, self.ids), np.searchsorted(ids, self.ids, "right")
        for at in range(0, len(mine), ROWS):
            part = slice(at, at + ROWS)
            score = (mine[part] @ x.T).astype(np.int64)
            for q in np.flatnonzero(last[part] > first[part]):
                score[q, first[at + q] : last[at + q]] = _LOW
            take = self._pick(score)
            scores = np.concatenate((self.score[part], np.take_along_axis(score, take, 1)), 1)
            found = np.concatenate((self.found[part], ids[take]), 1)
            found[scores == _LOW] = np.iinfo(np.int64).max
            order = np.lexsort((found, -(scores + 1)), axis=1)[:, : self.k]
            self.score[part] = np.take_along_axis(scores, order, 1)
            self.found[part] = np.take_along_axis(found, order, 1)

    def _pick(self, score: np.ndarray) -> np.ndarray:
        """Places of the k best of a tile; of equal scores the earlier ones."""
        n = score.shape[1]
        if n <= self.k:
            return np.broadcast_to(np.arange(n), score.shape)
        if np.abs(score[score != _LOW]).max(initial=0) < 2**62 // n:
            keys = np.where(score == _LOW, _LOW, score * n + (n - 1 - np.arange(n)))
            return np.argpartition(keys, n - self.k, axis=1)[:, n - self.k :]
        return np.argsort(-(score + 1), axis=1, kind="stable")[:, : self.k]

    def rows(self) -> pa.RecordBatch:
        own, place = np.nonzero(self.score != _LOW)
        columns = [self.ids[own], self.found[own, place], self.score[own, place]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _ranked(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` of the k best rows of each query.

    Queries are the rows for which ``is_query`` holds; candidates are all rows
    but those with the query's own id. Components count as floor(scale * x), so
    scores are whole numbers; they are exact while they fit 63 bits. Equal scores
    go by the smaller id. A query with fewer candidates gets fewer rows.

    Rows with a NULL id, a NULL vector, or a NULL, NaN or infinite component take
    no part. A shorter vector counts as ending in zeros. Of rows that repeat a
    query's id the least vector asks; repeated candidates are all candidates. An
    empty table gives no rows. Other columns are not read.
    """
    candidates = whole_vectors(rows, id_column, vector_column, scale)
    asked = whole_vectors(rows.filter(is_query), id_column, vector_column, scale).groupBy("id").agg(F.min("x").alias("x"))
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    context = rows.sparkSession.sparkContext
    found = []
    for number in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks().sort_by("id")
        ids = got.column("id").to_numpy()
        vectors = got.column("x").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.float64()))
        shared = context.broadcast((ids, _matrix(vectors)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = _Best(*shared.value, k)
            for batch in batches:
                if not len(best.ids):
                    break
                for at in range(0, batch.num_rows, TILE):
                    tile = batch.slice(at, TILE)
                    ids = tile.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(ids, kind="stable")
                    best.add(ids[order], _matrix(tile.column(1))[order])
            yield best.rows()

        found.append(candidates.mapInArrow(run, "query_id long, vec_id long, score long"))
    lists = reduce(DataFrame.unionByName, found).withColumn("branch", F.spark_partition_id() % BRANCHES)
    merged = _ranked(_ranked(lists, k, "query_id", "branch"), k, "query_id")
    return merged.select("query_id", "rank", "vec_id", "score")
