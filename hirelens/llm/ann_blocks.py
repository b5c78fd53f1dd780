"""Exact nearest neighbours by a block matrix join with quantised tiles.

All vectors are dealt over stripes of about ``stripe_rows`` rows; the stated
query set is sent to every stripe, in blocks. Within a stripe each pair of a query
block and a tile of vectors is one int8 matrix product (done in float32 over slices
of up to ``EXACT`` dimensions, where products and sums of these integers are exact,
and summed in double precision). It gives every inner product with
an error bound that follows from the two rounding residuals:

    x = s*q + r:  |<x,y> - s*t*<q,p>| <= |r||y| + |s*q||u|   (u the residual of y)

A pair whose upper bound lies below the k-th lower bound so far cannot be among
the k nearest. The others are computed again from the original vectors in double
precision, and a heap of k per query takes them up. The heaps of all stripes then
meet in one window per query, limited to k rows per query and task before the
shuffle. The result is exact, ties going to the smaller id.

Memory of a task: one stripe plus one block of queries and their product.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different length are never compared; rows
that repeat an id are separate candidates, but never for a query of the same id;
null ids take no part; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

#: Queries and vectors of one product.
BLOCK, TILE = 512, 4096
#: 127 * 127 times this is below 2^24.
EXACT = 1024


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


class Tile:
    """Quantised rows with what their error bounds need."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        norm = np.sqrt((rows * rows).sum(axis=1))
        scale = np.abs(rows).max(axis=1) / 127.0
        scale[scale == 0] = 1.0  # a denormal that underflows: everything goes to the residual
        self.int8 = np.rint(rows / scale[:, None]).astype(np.int8)
        back = self.int8 * scale[:, None]
        rest = rows - back
        self.scale = scale
        # A hair more than the exact values, so that rounding cannot break the bound.
        self.norm = norm * (1 + 1e-9)
        self.back_norm = np.sqrt((back * back).sum(axis=1)) * (1 + 1e-9)
        self.rest_norm = np.sqrt((rest * rest).sum(axis=1)) * (1 + 1e-9) + 1e-300


def block_nearest(queries: Tile, tile: Tile, heaps: list[list[tuple[float, int]]], k: int) -> None:
    """Take the tile's vectors up into the queries' heaps of (score, -id)."""
    product = np.zeros((len(queries.ids), len(tile.ids)))
    for d in range(0, queries.int8.shape[1], EXACT):
        product += queries.int8[:, d : d + EXACT].astype(np.float32) @ tile.int8[:, d : d + EXACT].astype(np.float32).T
    about = product * (queries.scale[:, None] * tile.scale[None, :])
    slack = (queries.rest_norm[:, None] * tile.norm[None, :] + queries.back_norm[:, None] * tile.rest_norm[None, :]) + 1e-9 * np.abs(about)
    own = queries.ids[:, None] == tile.ids[None, :]
    low = np.where(own, -np.inf, about - slack)
    high = np.where(own, -np.inf, about + slack)
    if low.shape[1] > k:
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        least = np.full(len(low), -np.inf)
    held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    q, v = np.nonzero((high >= np.maximum(least, held)[:, None]) & ~own)
    for a in range(0, len(q), 65536):
        at, to = q[a : a + 65536], v[a : a + 65536]
        score = (queries.rows[at] * tile.rows[to]).sum(axis=1)
        for i, s, vec in zip(at.tolist(), score.tolist(), tile.ids[to].tolist()):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (s, -vec))
            elif (s, -vec) > heap[0]:
                heapq.heapreplace(heap, (s, -vec))


def _matrix(column_: pa.Array) -> np.ndarray:
    n = len(column_)
    return np.asarray(column_.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def searcher(k: int):
    """Rows come sorted by (stripe, dim, role): a stripe's vectors, then its queries."""

    def answers(vectors: list[Tile], ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        queries = Tile(np.concatenate(ids), np.concatenate(rows))
        heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        for tile in vectors:
            block_nearest(queries, tile, heaps, k)
        found = [(int(q), -vec, s) for q, heap in zip(queries.ids, heaps) for s, vec in heap]
        cols = zip(*found) if found else ((), (), ())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))],
                               ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_held, vectors, ids, rows, n = None, [], 0, [], [], [], 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("stripe", "dim", "role")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                now = (int(keys[0, a]), int(keys[1, a]))
                if now != key:
                    if n:
                        yield answers(vectors, ids, rows)
                    key, held, n_held, vectors, ids, rows, n = now, [], 0, [], [], [], 0
                part = batch.slice(a, b - a)
                one, matrix = part.column("id").to_numpy(), _matrix(part.column("vector"))
                if keys[2, a] == 0:
                    vectors += [Tile(one[i : i + TILE], matrix[i : i + TILE]) for i in range(0, len(one), TILE)]
                    continue
                for i in range(0, len(one), BLOCK):
                    ids.append(one[i : i + BLOCK])
                    rows.append(matrix[i : i + BLOCK])
                    n += len(ids[-1])
                    if n >= BLOCK:
                        yield answers(vectors, ids, rows)
                        ids, rows, n = [], [], 0
        if n:
            yield answers(vectors, ids, rows)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            stripe_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products
    of each query row (``is_query``) with all other rows of ``df``."""
    vector = column(df, vector_col)
    base = df.select(column(df, id_col).cast("bigint").alias("id"), vector.cast("array<double>").alias("vector"),
                     F.coalesce(is_query, F.lit(False)).alias("query"))
    base = base.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    stripes = max(1, -(-base.count() // stripe_rows))
    turn = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(stripes)).cast("int")
    vectors = base.select(turn.alias("stripe"), "dim", F.lit(0).alias("role"), "id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    queries = base.filter("query").select(every.alias("stripe"), "dim", F.lit(1).alias("role"), "id", "vector")
    dealt = vectors.unionByName(queries).repartition(stripes, "stripe").sortWithinPartitions("stripe", "dim", "role")
    found = dealt.mapInArrow(searcher(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
