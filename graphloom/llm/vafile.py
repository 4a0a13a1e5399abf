"""Exact top-k search by inner product over vector-approximation files.

Vectors are whole numbers. Equal ones form a class, of which only the first k + 1
rows can be in a result. The classes are written in chunks. A chunk's file
has for each entry of a vector one byte, the number of the cell that it is in; cells are
quantiles of the chunk's own entries in that dimension, and the least and the
largest entry in each cell are kept with it. From these come a lower and an upper bound of a
score without the vectors. Queries are dealt to blocks and chunks to groups of a few; each block meets each
group in one task. There the cells are scanned for bounds, and vectors are
read, those with the best bound first, until no bound that is left reaches
the score of the last of the k + 1 best classes so far. A group gives a block k + 1 classes for
each query, whatever the vectors are like, and the best of these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, ship
from .vectors import matrix, usable, whole, wider

ship(__name__)

#: Cells of each dimension of a chunk, 256 at most; vectors of a chunk; queries of a block; chunks of a group.
CELLS, CHUNK, BLOCK, TOGETHER = 64, 4096, 1024, 4
#: Vectors read together.
STEP = 32
_EXACT, _LONG = 1 << 53, (1 << 63) - 1


def approximate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of x, and the least and the largest entry in each cell of each dimension."""
    n, d = x.shape
    cells = np.zeros((n, d), dtype=np.uint8)
    low = np.zeros((CELLS, d), dtype=np.int64)
    high = np.zeros((CELLS, d), dtype=np.int64)
    marks = np.sort(x, axis=0)[np.arange(1, CELLS) * n // CELLS]
    for j in range(d):
        cells[:, j] = c = np.searchsorted(marks[:, j], x[:, j], side="right")
        order = np.argsort(c, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
        low[c[order][first], j] = np.minimum.reduceat(x[order, j], first)
        high[c[order][first], j] = np.maximum.reduceat(x[order, j], first)
    return cells, low, high


FILE = "n int, dim int, cls binary, first binary, none binary, cells binary, low binary, high binary, x binary"


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows cls, vec_id (the class's first), x."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            x = matrix(part.column("x"))
            ids = part.column("vec_id")
            fields = (part.column("cls").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), *approximate(x), x)
            row = {"n": x.shape[0], "dim": x.shape[1]} | dict(zip(("cls", "first", "none", "cells", "low", "high", "x"), map(np.ndarray.tobytes, map(np.ascontiguousarray, fields)), strict=True))
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int32() if k in ("n", "dim") else pa.binary()) for k in row]))


def scores_of(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Inner products, held within the range of long."""
    if largest < _LONG // 2:
        return x @ q
    return np.array([max(-_LONG - 1, min(_LONG, sum(map(int.__mul__, r, q.tolist())))) for r in x.tolist()], dtype=np.int64)


class Best:
    """The best classes of one query so far: score, whether the first id is null, first id, class."""

    def __init__(self, most: int):
        self.most, self.rows = most, [np.zeros(0, dtype=np.int64)] * 4

    def add(self, *more: np.ndarray) -> None:
        score, none, first, cls = (np.concatenate(x) for x in zip(self.rows, more, strict=True))
        # ~ reverses the order of whole numbers, the least among them
        order = np.lexsort((cls, first, none, ~score))[: self.most]
        self.rows = [x[order] for x in (score, none, first, cls)]

    def least(self) -> float:
        return self.rows[0][-1] if len(self.rows[0]) == self.most else -np.inf


def search(chunk: dict, q: np.ndarray, best: list[Best]) -> int:
    """Bring best up to date with a chunk; the number of vectors that were read."""
    n, dim, read = chunk["n"], chunk["dim"], 0
    take = lambda name, dtype, *shape: np.frombuffer(chunk[name], dtype=dtype).reshape(shape)
    cells, x = take("cells", np.uint8, n, dim), take("x", np.int64, n, dim)
    cls, first, none = take("cls", np.int64, n), take("first", np.int64, n), take("none", np.bool_, n).astype(np.int64)
    wide = max(dim, q.shape[1])
    q, x = wider(q, wide), wider(x, wide)
    column = np.arange(dim)
    low, high = (wider(take(name, np.int64, CELLS, dim)[cells, column].astype(float), wide) for name in ("low", "high"))
    up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    largest = np.abs(q.astype(float)) @ np.maximum(np.abs(low), np.abs(high)).max(axis=0, initial=0)
    # sums below 2 ** 53 are exact
    slack = np.where(largest < _EXACT, 0.0, largest * wide * 2.0**-50)
    upper = up @ high.T + down @ low.T + slack[:, None]
    floor = np.array([b.least() for b in best])
    if n >= best[0].most and np.isneginf(floor).any():
        lower = up @ low.T + down @ high.T - slack[:, None]
        floor = np.maximum(floor, np.partition(lower, n - best[0].most, axis=1)[:, n - best[0].most])
    for i, b in enumerate(best):
        near = np.flatnonzero(upper[i] >= floor[i])
        near = near[np.argsort(-upper[i, near], kind="stable")]
        for at in range(0, len(near), STEP):
            some = near[at : at + STEP]
            if upper[i, some[0]] < b.least():
                break
            read += len(some)
            b.add(scores_of(x[some], q[i], largest[i]), none[some], first[some], cls[some])
    return read


def _meet(most: int):
    """Queries of a block against the chunks of a group."""

    def meet(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        q = matrix(queries.column("x"))
        best = [Best(most) for _ in range(len(q))]
        if len(q):
            for chunk in chunks.to_pylist():
                search(chunk, q, best)
        row = np.repeat(np.arange(len(q)), [len(b.rows[0]) for b in best]) if len(q) else np.zeros(0, dtype=np.int64)
        score, none, first, cls = (np.concatenate([b.rows[k] for b in best] or [np.zeros(0, dtype=np.int64)]) for k in range(4))
        out = {"query": queries.column("query").take(pa.array(row)), "query_id": queries.column("query_id").take(pa.array(row))}
        return pa.table(out | {"cls": cls, "score": score, "first": pa.array(first, mask=none.astype(bool))})

    return meet


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which is_query holds the k other rows with the highest inner products.

    An entry c of a vector, as double, counts as floor(scale * c), held within 2 ** 53 either way; a score beyond the range
    of long is held within it. Every row is a candidate for every query but itself, also where rows share an id or a vector. Ties
    go to the smaller id, a null id comes after all others. A query with fewer than k candidates gets all. Vectors that
    are null or hold null or non-finite entries take no part; a shorter vector, an empty one too, counts as ending with
    noughts. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    rows = usable(vectors, vector).select(F.col(id_column).cast("long").alias("vec_id"), whole(vector, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # numbers given once and written out, so that a lost executor can't change them
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    in_class = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.withColumn("place", F.row_number().over(in_class)).withColumn("cls", F.first("row").over(in_class)).filter(F.col("place") <= k + 1)
    members = checkpoint(members.select("cls", "place", "row", "vec_id", F.when(F.col("place") == 1, F.col("x")).alias("x")))
    chunks = checkpoint(members.filter("place = 1").select("cls", "vec_id", "x").mapInArrow(_file, FILE).withColumn("chunk", F.monotonically_increasing_id()))
    queries = rows.filter("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "x")
    blocks, groups = max(1, -(-queries.count() // BLOCK)), max(1, -(-chunks.count() // TOGETHER))

    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("group", dealt("chunk", groups)).withColumn("block", each(blocks)).groupBy("block", "group")
    right = queries.withColumn("block", dealt("query", blocks)).withColumn("group", each(groups)).groupBy("block", "group")
    met = left.cogroup(right).applyInArrow(_meet(k + 1), "query long, query_id long, cls long, score long, first long")

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("first").asc_nulls_last(), "cls")
    met = met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("query", "query_id", "cls", "score")
    found = met.join(members.select("cls", "row", "vec_id"), "cls").filter("row != query")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
