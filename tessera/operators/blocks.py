"""All pairs of two tables of vectors, block by block.

Both tables are dealt into blocks of about ``BLOCK_ROWS`` rows; each pair of blocks is one cogrouped task that multiplies two matrices
and hands on what its rows need: a top k, or a spanning forest and counts.  A row travels once for each block of the other table.
Nothing but the number of rows reaches the driver, and the plan reads each table once.

A matrix product's last bits depend on its shape, so what decides is scored again in the order of the dimensions, as
``functions.vectors.dot`` does: results do not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import to_matrix

BLOCK_ROWS = 8_192
#: Scores that a task holds at once; a whole block's would be 32 times as many.
TILE = 1 << 21


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, added in the order of the dimensions."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def margins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a``, how far its product with a row of ``b`` may be from the exact score."""
    return 4 * a.shape[1] * 2.0**-53 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max(initial=0.0)


def pair_scores(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`exact_scores` of the rows ``i`` of ``a`` with the rows ``j`` of ``b``, a dimension at a time, so that no rows are copied."""
    out = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[i] * y[j]
    return out


def best_k(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, above: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, key, score)`` of the best ``k`` vectors for each query by exact score; ties go to the smaller key.

    Equal vectors are scored once and give their smallest keys.  Queries are taken in turn, so that about ``TILE`` scores are held at once.
    """
    order = np.argsort(own, kind="stable")
    own, vectors = own[order], np.ascontiguousarray(vectors[order])
    _, first, same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(same, kind="stable")
    sizes = np.minimum(np.bincount(same), k)
    begins = np.concatenate(([0], np.cumsum(np.bincount(same))))[:-1]
    distinct = vectors[first]
    step = max(1, TILE // len(distinct))
    found = []
    for at in range(0, len(queries), step):
        q, d, exact = _best_of(queries[at : at + step], distinct, sizes, k, above)
        times = sizes[d]
        q, exact, start = np.repeat(q, times), np.repeat(exact, times), np.repeat(begins[d], times)
        nth = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
        key = own[by_group[start + nth]]
        order = np.lexsort((key, -exact, q))
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
        found.append((ids[at + q[order]], key[order], exact[order]))
    if not found:
        return ids[:0], own[:0], np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best_of(queries: np.ndarray, distinct: np.ndarray, sizes: np.ndarray, k: int, above: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and distinct vectors with exact scores: what may be among the best ``k``, of which each vector gives up to ``sizes``."""
    scores = queries @ distinct.T
    n = min(k, len(distinct))
    last = -np.partition(-scores, n - 1, 1)[:, n - 1]
    q, d = np.nonzero(scores >= (last - 2 * margins(queries, distinct))[:, None])
    exact = pair_scores(queries, q, distinct, d)
    if above is not None:
        q, d, exact = (x[exact > above] for x in (q, d, exact))
    order = np.lexsort((-exact, q))
    q, d, exact = q[order], d[order], exact[order]
    # a vector goes when those before it by score, its ties left out, fill the query's places
    before = np.cumsum(sizes[d]) - sizes[d]
    begins = np.searchsorted(q, q)
    starts = np.concatenate(([True], (q[1:] != q[:-1]) | (exact[1:] != exact[:-1]))) if len(q) else np.empty(0, bool)
    tied = np.maximum.accumulate(np.where(starts, np.arange(len(q)), 0))
    kept = before[tied] - before[begins] < k
    return q[kept], d[kept], exact[kept]


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _dealt(df: DataFrame, key: str, vector: str, blocks: int) -> DataFrame:
    """``key, vector`` with a block; rows are dealt by their places, so that rows that repeat fill no block."""
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), block.alias("own"))


def over_pairs(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, keys: tuple[str, str], vector: str = "embedding", rows: int | None = None) -> DataFrame:
    """``work(left block, right block)`` over all pairs of blocks; each block has ``key`` and ``vector``."""
    rows = rows or BLOCK_ROWS
    n, m = _blocks(left, rows), _blocks(right, rows)
    a = _dealt(left, keys[0], vector, n).select(F.col("own").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("r"), "key", "vector")
    b = _dealt(right, keys[1], vector, m).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("l"), F.col("own").alias("r"), "key", "vector")
    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInArrow(work, schema)


def over_own_pairs(df: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, key: str, vector: str = "embedding", rows: int | None = None) -> DataFrame:
    """Like :func:`over_pairs` for a table and itself: each pair of blocks meets once, and a block meets itself."""
    n = _blocks(df, rows or BLOCK_ROWS)
    own = _dealt(df, key, vector, n)
    a = own.select(F.col("own").alias("l"), F.explode(F.sequence(F.col("own"), F.lit(n - 1))).alias("r"), "key", "vector")
    b = own.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("l"), F.col("own").alias("r"), "key", "vector")
    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInArrow(work, schema)


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", above: float | None = None, rows: int | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the best ``k`` vectors for every query, whatever their numbers; null vectors take no part."""

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v, score = best_k(to_matrix(asked["vector"]), asked["key"].to_numpy(), to_matrix(held["vector"]), held["key"].to_numpy(), k, above)
        return pa.table({"q": q, "v": v, "score": score})

    vectors, queries = (d.filter(F.col(vector).isNotNull()) for d in (vectors, queries))
    return ranked(over_pairs(queries, vectors, work, "q long, v long, score double", (query_key, key), vector, rows), k, query_key, key)


def ranked(found: DataFrame, k: int, query_key: str, key: str) -> DataFrame:
    """The best ``k`` of ``q, v, score`` for each query, with ``rank``."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "v")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_key), F.col("v").alias(key), "score", "rank")


def above(scores: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which exact scores are above a threshold, from a product of ``a`` and ``b``."""
    near = scores > threshold
    q, v = np.nonzero(np.abs(scores - threshold) <= margins(a, b)[:, None])
    near[q, v] = pair_scores(a, q, b, v) > threshold
    return near
