"""Exact search by inner product.

Two plans give the same results.  ``top_k`` is declarative, for one query vector: TakeOrderedAndProject.  ``batch_top_k``
multiplies matrices per Arrow batch and keeps the best ``k`` of each batch, so that what is shuffled does not depend on the
number of vectors in a batch; beyond a checked number of queries it joins blocks instead (``operators.blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_hash
from ..functions.vectors import by_dimension, dot, gathered, to_matrix
from ..storage import materialize
from . import blocks, shards
from .encode import encoded

#: Query vectors that are sent to every task at once.
MAX_QUERIES = 4_096


def weighted_query(terms: DataFrame, vectors: DataFrame, key: str = "vec_id", weight: str = "weight", vector: str = "embedding") -> DataFrame:
    """One row ``query``: the sum of weight times vector over terms; not renormalised.

    A term without a stored vector is ignored; a null weight counts as 1; negative weights repel.
    """
    found = terms.join(vectors.select(key, vector), key)
    w = F.coalesce(F.col(weight), F.lit(1.0))
    dims = by_dimension(found.select(w.alias("w"), vector), "w", vector=vector)
    return gathered(dims.groupBy("pos").agg(F.sum(F.col("w") * F.col("x")).alias("x")), to="query")


def signed(weight: Column, sign: Column) -> Column:
    return weight * F.when(sign == "-", -1).otherwise(1)


def random_query(dims: int, seed: int = 0) -> list[float]:
    """The vector of an empty request: independent normal values of variance 1 / dims."""
    return (np.random.default_rng(seed).standard_normal(dims) / np.sqrt(dims)).tolist()


def _one(query: DataFrame) -> Column:
    """The vector of a query of one row, as a literal."""
    rows = query.select("query").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one query row is asked for, not {len(rows) or 'none'}{' or more' if rows else ''}")
    return F.array(*[F.lit(float(x)) for x in rows[0]["query"]])


def top_k(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", bias: Column | None = None) -> DataFrame:
    """The ``k`` best rows for one query vector, with ``score``; ties go to the smaller key.

    ``query`` must have one row.  ``bias`` is added to the score.  Null vectors are left out.
    """
    score = dot(vector, _one(query))
    scored = vectors.filter(F.col(vector).isNotNull()).withColumn("score", score if bias is None else score + bias)
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def request_query(terms: DataFrame, predefined: DataFrame, dims: int, defaults: DataFrame | None = None, encode: Callable[[str], Callable[[list], np.ndarray]] | None = None, seed: int = 0) -> DataFrame:
    """:func:`total_query` of a request; one without terms gets a random vector and the default terms."""
    if not terms.isEmpty():
        return total_query(terms, predefined, encode)
    spark = terms.sparkSession
    chance = spark.createDataFrame([(random_query(dims, seed), None, None, None, 1.0)], terms.schema)
    return total_query(chance if defaults is None else chance.unionByName(defaults), predefined, encode)


def result_rows(found: DataFrame, debug: bool = False, url: str = "url") -> DataFrame:
    """Results as they are served: score, URL, name hash, format mask, dimensions, and debug fields only if asked for.

    Columns that ``found`` lacks are null; the mask is 0.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in found.columns else F.lit(None).cast(kind)
    size = F.when(have("width", "int").isNotNull(), F.struct(have("width", "int").alias("width"), have("height", "int").alias("height")))
    extra = F.struct(have("scores", "array<double>").alias("scores"), have("shards", "array<int>").alias("shards"), have("timestamp", "long").alias("timestamp"))
    return found.select(
        F.col("score").cast("float").alias("score"), url, name_hash(url).alias("hash"), F.coalesce(have("mask", "long"), F.lit(0)).cast("long").alias("formats"),
        size.alias("dimensions"), (extra if debug else F.lit(None).cast("struct<scores:array<double>,shards:array<int>,timestamp:long>")).alias("debug"),
    )


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", above: float | None = None) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the best ``k`` vectors for every query.

    Null vectors neither ask nor answer.  Up to ``MAX_QUERIES`` queries are sent to all tasks; more than that meet the vectors in blocks.
    """
    vectors, queries = (d.filter(F.col(vector).isNotNull()) for d in (vectors, queries))
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        return blocks.block_top_k(vectors, queries, k, key, query_key, vector, above)
    rows = queries.select(F.col(query_key).cast("long"), vector).limit(MAX_QUERIES).toArrow()
    ids, matrix = rows.column(0).to_numpy(), to_matrix(rows.column(1))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                q, v, score = blocks.best_k(matrix, ids, to_matrix(batch.column(1)), batch.column(0).to_numpy(), k, above)
                yield pa.RecordBatch.from_pydict({"q": q, "v": v, "score": score})

    found = vectors.select(F.col(key).cast("long"), vector).mapInArrow(best, "q long, v long, score double")
    return blocks.ranked(found, k, query_key, key)


def without_video(scored: DataFrame, frame: str = "frame") -> DataFrame:
    """Results without frames of videos."""
    return scored.filter(F.col(frame).isNull())


def best_per_container(scored: DataFrame, container: str = "container", key: str = "vec_id") -> DataFrame:
    """The best-scored frame of each container."""
    order = Window.partitionBy(container).orderBy(F.col("score").desc(), key)
    return scored.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def route(query: DataFrame, centroids: DataFrame, shard: str = "shard_id", centroid: str = "centroid") -> DataFrame:
    """The shard whose centroid has the largest inner product; ties go to the larger shard."""
    scored = centroids.select(F.struct(dot(centroid, _one(query)).alias("score"), shard).alias("s"))
    return scored.agg(F.max("s").alias("s")).select(f"s.{shard}", "s.score")


def routed_candidates(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int, chunk: int = blocks.BLOCK_ROWS, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", shard: str = "shard_id") -> DataFrame:
    """``query_id, vec_id, score, choice``: the best ``k`` of each of the ``probes`` shards whose centroids are best for a query.

    ``assigned`` has ``vec_id, shard_id, embedding``, a row for each shard that holds a vector.  Queries meet only the shards they are routed to;
    a shard of more than ``chunk`` vectors is dealt into parts, which meet its queries in tasks of their own.  ``choice`` is 1 for the best shard.
    """
    held = assigned.filter(F.col(vector).isNotNull())
    asked = queries.filter(F.col(vector).isNotNull())
    routes = materialize(shards.nearest_shards(asked, centroids, probes, query_key, vector).select(query_key, F.col("shard_id").alias("l"), "choice"))
    parts = held.groupBy(F.col(shard).cast("long").alias("l")).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_parts"))
    b = held.select(F.col(shard).cast("long").alias("l"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).join(parts, "l")
    b = b.select("l", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int").alias("r"), "key", "vector")
    a = asked.select(F.col(query_key).cast("long").alias(query_key), F.col(vector).alias("vector")).join(routes, query_key).join(parts, "l")
    a = a.select("l", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("r"), F.col(query_key).alias("key"), "vector")

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"l": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v, score = blocks.best_k(to_matrix(mine["vector"]), mine["key"].to_numpy(), to_matrix(theirs["vector"]), theirs["key"].to_numpy(), k)
        return pa.table({"l": np.full(len(q), mine["l"][0].as_py()), "q": q, "v": v, "score": score})

    found = a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInArrow(best, "l long, q long, v long, score double")
    found = found.withColumnRenamed("q", query_key).join(routes, [query_key, "l"])
    return found.groupBy(query_key, F.col("v").alias(key)).agg(F.max("score").alias("score"), F.min("choice").alias("choice"))


def routed_top_k(assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, probes: int = 4, key: str = "vec_id", query_key: str = "query_id", **how: Any) -> DataFrame:
    """``query_id, vec_id, score, rank``: the best ``k`` vectors of the shards that each query is routed to."""
    found = routed_candidates(assigned, queries, centroids, k, probes, key=key, query_key=query_key, **how)
    return blocks.ranked(found.select(F.col(query_key).alias("q"), F.col(key).alias("v"), "score"), k, query_key, key)


def novel(candidates: DataFrame, indexed: DataFrame, most: float = 0.99, least_score: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates whose nearest indexed vector is at most ``most`` and whose score is high enough; one without a vector is not novel."""
    candidates = candidates.filter(F.col(vector).isNotNull())
    nearest = blocks.block_top_k(indexed, candidates.withColumnRenamed(key, "query_id"), 1, key, vector=vector)
    near = nearest.select(F.col("query_id").alias(key), F.col("score").alias("nearest"))
    out = candidates.join(near, key, "left").filter(F.coalesce("nearest", F.lit(-1.0)) <= most)
    return out if least_score is None else out.filter(F.col("score") > least_score)


def descriptor_scales(terms: DataFrame, names: list[str], name: str = "predefined_embedding", weight: str = "weight") -> DataFrame:
    """One row ``scales``: per configured descriptor, the weight of the terms that name it over 512."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name))
    sums = [F.coalesce(F.sum(F.when(at == k + 1, F.coalesce(weight, F.lit(1.0)))), F.lit(0.0)) / 512 for k in range(len(names))]
    return terms.agg(F.array(*sums).alias("scales"))


def refinements(query: DataFrame, direction: list[float], steps: int = 2) -> DataFrame:
    """The query moved along a direction: ``2 * steps + 1`` candidates."""
    d = F.array(*[F.lit(float(x)) for x in direction])
    out = query.withColumn("step", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    return out.withColumn("query", F.zip_with("query", d, lambda x, y: x + F.col("step") / steps * y))


def total_query(terms: DataFrame, predefined: DataFrame, encode: Callable[[str], Callable[[list], np.ndarray]] | None = None) -> DataFrame:
    """The vector of a request whose terms hold raw vectors, predefined names, texts and images.

    One term may hold several kinds; each counts with the term's weight.  Texts and images need
    an encoder; without one they are an error, never a guess.  ``encode(kind)`` gives the encoder of ``text`` or ``image``, which
    takes lists in batches.
    """
    w = F.coalesce("weight", F.lit(1.0)).alias("weight")
    raw = terms.filter(F.col("embedding").isNotNull()).select(w, F.col("embedding").cast("array<double>").alias("embedding"))
    named = terms.filter(F.col("predefined_embedding").isNotNull()).select(w, F.col("predefined_embedding").alias("name"))
    named = named.join(predefined.select("name", F.col("embedding").cast("array<double>").alias("embedding")), "name").drop("name")
    parts = raw.unionByName(named)
    for kind in ("text", "image"):
        asked = terms.filter(F.col(kind).isNotNull()).select(w, F.col(kind).alias("value"))
        if encode is not None:
            vectors = encoded(asked, encode(kind), "weight", "value", unit=False)
            parts = parts.unionByName(vectors.select("weight", F.col("embedding").cast("array<double>").alias("embedding")))
        elif not asked.isEmpty():
            raise ValueError("text and image terms need an encoder")
    dims = by_dimension(parts, "weight").groupBy("pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return gathered(dims, to="query")
