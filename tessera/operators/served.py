"""A served graph: nodes packed for point reads, and searches that read only the nodes they visit.

A packed node has its vector in half precision, and its neighbours with their product codes beside them, so that a visit is one read.  Nodes lie in
buckets by id.  A search is a few joins: each query's next nodes meet the buckets, and what they give moves the query's beam on.  Beams of all
queries move together; a query's state is its beam and what it has seen, which the number of steps bounds.  No task holds a shard, whatever the
graph's size, and nothing but one truth value a step reaches the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import fp16_encode
from ..storage import drop, fresh_path, materialize
from . import blocks
from .quantize import ProductQuantizer, pq_encode
from .shards import nearest_shards

_STATE = "query_id long, query binary, next array<long>, ids array<long>, near array<double>, seen array<long>, found array<long>, scores array<double>, reads long"


def packed_nodes(graph: DataFrame, vectors: DataFrame, quantizer: ProductQuantizer, key: str = "vec_id", vector: str = "embedding", dead: str | None = None) -> DataFrame:
    """``id, vector, neighbours, dead`` of each node: bytes of its vector, and ``id, code`` of what the graphs of its shards lead to.

    ``graph`` has ``id, neighbours``, a row for each shard of a node; ``dead`` names a column of ``vectors`` that marks rows to pass through but not to give.
    """
    edges = graph.select("id", F.explode("neighbours").alias("to")).distinct()
    code = F.transform("codes", lambda c: c.cast("short"))
    codes = pq_encode(vectors.filter(F.col(vector).isNotNull()), quantizer, key, vector).select(F.col(key).alias("to"), code.alias("code"))
    lists = edges.join(codes, "to").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("to").alias("id"), "code"))).alias("neighbours"))
    own = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), fp16_encode(vector).alias("vector"), (F.col(dead) if dead else F.lit(False)).alias("dead"))
    # a node of a graph without edges is a node still
    return own.join(graph.select("id").distinct(), "id").join(lists, "id", "left")


def write_packed(nodes: DataFrame, buckets: int) -> DataFrame:
    """The nodes as a table in ``buckets`` buckets by id, in the shared folder; joins by id read it without moving it."""
    name = f"tessera_packed_{uuid.uuid4().hex}"
    path = fresh_path(nodes.sparkSession, "packed")
    nodes.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    return nodes.sparkSession.table(name)


def _moved(state: dict, reads: list[tuple], quantizer: ProductQuantizer, width: int, expand: int) -> dict:
    """A query's state after visits ``(id, vector, neighbours, dead)``."""
    query = np.frombuffer(state["query"])
    seen, found, scores = set(state["seen"]), list(state["found"]), list(state["scores"])
    visited = set(found) | set(state["next"])
    near = dict(zip(state["ids"], state["near"], strict=True))
    fresh: dict[int, list[int]] = {}
    for node, vector, neighbours, dead in reads:
        # a dead row is visited, but has no score to give
        found.append(node)
        scores.append(None if dead else float(blocks.exact_scores(np.frombuffer(vector, "<f2").astype(np.float64)[None], query[None])[0]))
        fresh |= {n["id"]: n["code"] for n in neighbours or [] if n["id"] not in seen}
    if fresh:
        table = quantizer.table(query)
        codes = np.array(list(fresh.values()), np.int64)
        near |= dict(zip(fresh, table[np.arange(table.shape[0]), codes].sum(1).tolist(), strict=True))
    best = sorted(near, key=lambda n: (-near[n], n))[:width]
    return state | {
        "next": [n for n in best if n not in visited][:expand], "ids": best, "near": [near[n] for n in best],
        "seen": sorted(seen | fresh.keys()), "found": found, "scores": scores, "reads": state["reads"] + len(reads),
    }


def packed_search(nodes: DataFrame, queries: DataFrame, starts: DataFrame, centroids: DataFrame, quantizer: ProductQuantizer, k: int, width: int = 64, expand: int = 8, probes: int = 2, steps: int = 50, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank, reads``: beam search from the starts of the ``probes`` shards whose centroids are best for a query.

    ``nodes`` is what :func:`write_packed` gives; ``starts`` has ``shard_id, id``, a row for each shard.  ``width`` nodes are kept by their codes, of which the
    ``expand`` best that weren't visited are read in a step; the search ends when all of the beam are.  Visited rows are ranked by their own vectors.
    ``reads`` is how many nodes the query read.
    """
    state_type = _STATE

    def move(held: pa.Table, read: pa.Table) -> pa.Table:
        state, rows = held.to_pylist()[0], read.to_pylist()
        if rows:
            state = _moved(state, [(r["id"], r["vector"], r["neighbours"], r["dead"]) for r in sorted(rows, key=lambda r: r["id"])], quantizer, width, expand)
        else:
            state["next"] = []
        kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
        fields = [f.split(" ") for f in state_type.split(", ")]
        return pa.table({name: pa.array([state[name]], kinds[kind]) for name, kind in fields})

    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("query_id"), vector)
    routes = nearest_shards(asked, centroids, probes, "query_id", vector).join(starts, "shard_id").groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("next"))
    no_ids, no_scores = F.array().cast("array<long>"), F.array().cast("array<double>")
    as_bytes = F.pandas_udf(lambda x: x.map(lambda v: np.asarray(v, np.float64).tobytes()), "binary")
    state = materialize(
        asked.join(routes, "query_id").select(
            "query_id", as_bytes(vector).alias("query"), "next", no_ids.alias("ids"), no_scores.alias("near"), F.col("next").alias("seen"),
            no_ids.alias("found"), no_scores.alias("scores"), F.lit(0).cast("long").alias("reads"),
        )
    )
    for _ in range(steps):
        wanted = state.select(F.col("query_id").alias("asker"), F.explode("next").alias("id"))
        if wanted.isEmpty():
            break
        read = wanted.join(nodes.hint("merge"), "id")
        moved = materialize(state.groupBy("query_id").cogroup(read.groupBy("asker")).applyInArrow(move, state_type))
        drop(state)
        state = moved
    hits = state.select("query_id", "reads", F.explode(F.arrays_zip("found", "scores")).alias("h")).filter("h.scores IS NOT NULL")
    ranked = blocks.ranked(hits.select(F.col("query_id").alias("q"), F.col("h.found").alias("v"), F.col("h.scores").alias("score")), k, query_key, "vec_id")
    reads = state.select(F.col("query_id").alias("_of"), F.col("reads").alias("_reads"))
    return ranked.join(reads, F.col(query_key) == F.col("_of")).select(query_key, "vec_id", "score", "rank", F.col("_reads").alias("reads"))
