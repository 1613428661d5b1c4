"""Duplicate removal over vectors and keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, sign_code, to_matrix
from ..storage import materialize
from . import blocks
from .links import components


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows with a null key all stay, each as a key of its own."""
    alone = F.when(F.col("_key").isNull(), F.monotonically_increasing_id())
    w = Window.partitionBy("_key", "_alone").orderBy(*order)
    known = df.withColumn("_key", key).withColumn("_alone", alone)
    return known.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place", "_key", "_alone")


def ingest_dedup(df: DataFrame, url: str = "url", vector: str = "embedding", order: str = "vec_id") -> DataFrame:
    """First by the sign code of the vector, then by URL among what is left.  A row without one is no copy by it."""
    by_code = keep_first(df, sign_code(vector), F.col(order))
    return keep_first(by_code, F.col(url), F.col(order))


def near_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", groups: list[str] | None = None) -> DataFrame:
    """Pairs ``a < b`` with an inner product above the threshold.

    Vectors meet within ``groups`` (the result of one query, a shard): those bound the pairs.
    """
    groups = groups or []
    left = vectors.select(*groups, F.col(key).alias("a"), F.col(vector).alias("_x"))
    right = vectors.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col(key).alias("b"), F.col(vector).alias("_y"))
    on = F.col("a") < F.col("b")
    for g in groups:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return left.join(right, on).withColumn("score", dot("_x", "_y")).filter(F.col("score") > threshold).select(*groups, "a", "b", "score")


def _tiles(rows: int, columns: int) -> list[slice]:
    step = max(1, blocks.TILE // max(1, columns))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _block_links(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a block, the first column that links reach within it; the number of columns without one.

    Rows are taken in turn: what is held beside ``near`` is about ``blocks.TILE`` numbers.
    """
    n = near.shape[1]
    columns, rows = np.arange(n, dtype=np.int32), np.full(len(near), n, np.int32)
    while True:
        least = columns.copy()
        for at in _tiles(*near.shape):
            rows[at] = np.where(near[at], columns[None, :], np.int32(n)).min(1)
            np.minimum(least, np.where(near[at], rows[at, None], np.int32(n)).min(0), out=least)
        if (least == columns).all():
            return rows, columns
        columns = least


def near_blocks(ids: np.ndarray, a: np.ndarray, own: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of two blocks are above the threshold, a byte a pair; one key is not near itself."""
    near = np.empty((len(a), len(b)), bool)
    for at in _tiles(*near.shape):
        near[at] = blocks.above(a[at] @ b.T, a[at], b, threshold)
        near[at] &= ids[at, None] != own[None, :]
    return near


def near_classes(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """``vec_id, class, links`` of each vector: the smallest key that links reach, and how many others are above the threshold.

    All vectors that aren't null are compared with all, in pairs of blocks; a pair hands on a spanning forest and counts, not its links.
    """
    vectors = vectors.filter(F.col(vector).isNotNull())

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left["key"].to_numpy(), right["key"].to_numpy()
        if not len(ids) or not len(own):
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "n")})
        a, b = to_matrix(left["vector"]), to_matrix(right["vector"])
        itself = left["l"][0].as_py() == left["r"][0].as_py()
        near = near_blocks(ids, a, own, b, threshold)
        first, columns = _block_links(near)
        q, v = np.flatnonzero(first < len(own)), np.flatnonzero(near.any(0))
        back = np.zeros(len(v), np.int64) if itself else np.count_nonzero(near, 0)[v]
        return pa.table({"u": np.concatenate([ids[q], own[v]]), "v": np.concatenate([own[first[q]], own[columns[v]]]), "n": np.concatenate([np.count_nonzero(near, 1)[q], back])})

    found = materialize(blocks.over_own_pairs(vectors, links, "u long, v long, n long", key, vector, block))
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    roots = components(found.select("u", "v"))
    out = vectors.select(key).join(counts.withColumnRenamed("u", key), key, "left").join(roots.withColumnRenamed("node", key), key, "left")
    return out.select(key, F.coalesce("root", key).alias("class"), F.coalesce("n", F.lit(0)).alias("links"))


def greedy_near_dup(results: DataFrame, threshold: float = 0.95, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """In each query's result, by descending score, drop rows near one already kept.

    A group is the result list of one query, which its top-k bounds.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", key], ascending=[False, True], kind="stable")
        m = np.stack(rows[vector].to_numpy()).astype(np.float64)
        kept: list[int] = []
        for k in range(len(m)):
            if not kept or (m[kept] @ m[k]).max() <= threshold:
                kept.append(k)
        return rows.iloc[kept][[query, key, "score"]]

    kinds = {f.name: f.dataType.simpleString() for f in results.schema.fields}
    return results.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {key} {kinds[key]}, score double")


def discard_known(df: DataFrame, known: DataFrame, content: str, digest: str = "digest") -> DataFrame:
    """Rows whose content hash is not among the known ones."""
    marked = df.withColumn("_digest", F.md5(F.col(content).cast("string")))
    return marked.join(known.select(F.col(digest).alias("_digest")), "_digest", "left_anti").drop("_digest")
