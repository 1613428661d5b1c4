"""Proximity graphs: one shard is one group, whose size the sharding bounds.

Inside a group everything is a numpy matrix.  The analytic parts (degrees, merging, stitching) are
joins over edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .quantize import ProductQuantizer
from .blocks import block_top_k


def greedy_search(x: np.ndarray, neighbours: list[np.ndarray], start: int, query: np.ndarray, width: int, allowed: np.ndarray | None = None, approx: np.ndarray | None = None, beam: int = 1) -> tuple[list[int], dict[int, float]]:
    """Best-first search with a buffer of ``width``: the buffer, best first, and all visited with exact scores.

    A step visits the ``beam`` best nodes of the buffer that are not visited yet.  Nodes that are not ``allowed`` are
    passed over.  With ``approx``, approximate scores of all nodes, the buffer is ordered by those and only visited
    nodes are scored exactly, as where full vectors are costly to read.
    """
    near = (lambda nodes: approx[nodes]) if approx is not None else (lambda nodes: x[nodes] @ query)
    seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
    seen[start] = True
    buffer = np.array([start])
    scores = np.asarray(near(buffer), np.float64)
    visited: list[np.ndarray] = []
    while len(waiting := buffer[~done[buffer]][:beam]):
        done[waiting] = True
        visited.append(waiting)
        new = np.concatenate([neighbours[v] for v in waiting]) if len(waiting) > 1 else neighbours[waiting[0]]
        new = new[~seen[new]]
        if allowed is not None:
            new = new[allowed[new]]
        if len(new):
            new = np.unique(new) if len(waiting) > 1 else new
            seen[new] = True
            buffer, scores = np.concatenate([buffer, new]), np.concatenate([scores, near(new)])
            order = np.lexsort((buffer, -scores))[:width]
            buffer, scores = buffer[order], scores[order]
    at = np.concatenate(visited)
    return buffer.tolist(), dict(zip(at.tolist(), (x[at].astype(np.float64) @ query).tolist(), strict=True))


def batch_search(x: np.ndarray, neighbours: np.ndarray, start: int, queries: np.ndarray, width: int, beam: int = 1, near: np.ndarray | None = None, batch: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """:func:`greedy_search` of many queries at once: for each query in turn its place and the nodes it visited.

    ``neighbours`` is a matrix, filled up with -1.  The beams of a batch of queries move together, a step of all in a few array operations, so that a search
    costs its products and not a round of Python for each node.  With ``near``, (queries, nodes) approximate scores, those order the beam.
    """
    n = len(x)
    for at in range(0, len(queries), batch):
        asked = queries[at : at + batch]
        many = len(asked)

        def scored(q, to):
            return near[at + q, to] if near is not None else np.einsum("ij,ij->i", x[to], asked[q])  # noqa: B023

        seen, done = np.zeros((2, many, n + 1), bool)
        seen[:, start] = seen[:, n] = done[:, n] = True
        live = np.arange(many)
        nodes, scores = np.full((many, 1), start), scored(live, np.full(many, start))[:, None]
        while True:
            waiting = ~done[live[:, None], nodes]
            waiting &= np.cumsum(waiting, 1) <= beam
            going = waiting.any(1)
            live, nodes, scores = live[going], nodes[going], scores[going]
            if not len(live):
                break
            row, col = np.nonzero(waiting[going])
            visit = nodes[row, col]
            done[live[row], visit] = True
            to = neighbours[visit]
            q, to = np.repeat(row, to.shape[1]), np.where(to < 0, n, to).ravel()
            fresh = ~seen[live[q], to]
            q, to = np.divmod(np.unique(q[fresh] * (n + 1) + to[fresh]), n + 1)
            seen[live[q], to] = True
            counts = np.bincount(q, minlength=len(live))
            place = q, nodes.shape[1] + np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
            wider = ((0, 0), (0, int(counts.max(initial=0))))
            nodes, scores = np.pad(nodes, wider, constant_values=n), np.pad(scores, wider, constant_values=-np.inf)
            nodes[place], scores[place] = to, scored(live[q], to)
            order = np.lexsort((nodes, -scores), axis=1)[:, :width]
            nodes, scores = np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)
        for k in range(many):
            yield at + k, np.flatnonzero(done[k, :n])


def robust_prune(x: np.ndarray, point: int, candidates: np.ndarray, degree: int, alpha: float, is_query: np.ndarray | None = None, query_alpha: float = 1.0, saturate: bool = False) -> np.ndarray:
    """Up to ``degree`` neighbours: the nearest, then those not much nearer to one chosen before.

    A candidate goes when its inner product with a chosen one, times ``alpha`` (``query_alpha`` for query nodes), reaches that
    with the point.  With ``saturate``, and always for a query node, what went fills the free places, nearest first.
    """
    candidates = np.unique(candidates[candidates != point])
    rows = x[candidates]
    own = rows @ x[point]
    order = np.lexsort((candidates, -own))
    candidates, own, rows = candidates[order], own[order], rows[order]
    factor = alpha if is_query is None else np.where(is_query[candidates], query_alpha, alpha)
    alive = np.ones(len(candidates), bool)
    chosen: list[int] = []
    while len(chosen) < degree and alive.any():
        k = int(alive.argmax())
        chosen.append(k)
        alive &= factor * (rows @ rows[k]) < own
        alive[: k + 1] = False
    if saturate or (is_query is not None and is_query[point]):
        taken = set(chosen)
        chosen += [k for k in range(len(candidates)) if k not in taken][: degree - len(chosen)]
    return candidates[chosen].astype(np.int64)


def random_neighbours(n: int, degree: int, seed: int = 0) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.array([v for v in rng.choice(n, min(degree + 1, n), replace=False) if v != k][:degree], np.int64) for k in range(n)]


def build(x: np.ndarray, degree: int = 64, width: int = 192, most: int = 750, alpha: float = 1.2, passes: int = 2, seed: int = 0, beam: int = 8, is_query: np.ndarray | None = None, query_alpha: float = 1.0, saturate: bool = False) -> tuple[list[np.ndarray], int]:
    """Neighbour lists of all vectors and the start node, the medoid.

    For vectors of unit length a larger inner product is a smaller distance; ``alpha`` of at least 1
    keeps longer edges, as it shrinks what prunes.  Where some vectors are queries, a search for a query passes
    base vectors only, and pruning takes ``query_alpha`` for them.
    """
    n = len(x)
    closeness = x @ x.mean(0)
    if is_query is not None and not is_query.all():
        closeness = np.where(is_query, -np.inf, closeness)
    start = int(closeness.argmax())
    base = None if is_query is None else ~is_query
    neighbours = random_neighbours(n, min(degree, max(0, n - 1)), seed)
    for turn in range(passes):
        plain = turn == 0 and passes > 1
        how = {"alpha": 1.0 if plain else 1 / alpha, "is_query": is_query, "query_alpha": 1.0 if plain else 1 / query_alpha, "saturate": saturate}
        for p in np.random.default_rng(seed + 1 + turn).permutation(n):
            _, visited = greedy_search(x, neighbours, start, x[p], width, base if is_query is not None and is_query[p] else None, beam=beam)
            pool = np.array(sorted(visited, key=lambda v: -visited[v])[:most], np.int64)
            neighbours[p] = robust_prune(x, int(p), np.concatenate([pool, neighbours[p]]), degree, **how)
            for v in neighbours[p]:
                back = neighbours[v]
                if p not in back:
                    back = np.append(back, p)
                    neighbours[v] = robust_prune(x, int(v), back, degree, **how) if len(back) > degree else back
    return neighbours, start


#: What one task may hold of a shard's vectors, in single precision.
MAX_SHARD_BYTES = 4 << 30


def build_graphs(assigned: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: str | None = None, most_bytes: int = MAX_SHARD_BYTES, **options) -> DataFrame:
    """``shard_id, id, neighbours, is_start`` for ``assigned`` (``vec_id, shard_id``).

    A shard is built in one task, so its size is checked first: the number of shards must follow the number of vectors.
    ``is_query`` names a column of ``vectors`` that marks queries.
    """
    largest, n_shards = assigned.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count("n")).first()
    dims = len((vectors.select(vector).filter(F.col(vector).isNotNull()).first() or [[]])[0])
    if largest * dims * 4 > most_bytes:
        raise ValueError(f"a shard of {largest} vectors of {dims} dimensions is above {most_bytes} bytes: deal the vectors over more shards")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        ids = rows[key].to_numpy()
        marks = rows[is_query].to_numpy(bool) if is_query else None
        lists, start = build(np.stack(rows[vector].to_numpy()).astype(np.float32), is_query=marks, **options)
        return pd.DataFrame({"shard_id": rows["shard_id"].to_numpy(), "id": ids, "neighbours": [ids[v].tolist() for v in lists], "is_start": np.arange(len(ids)) == start})

    found = vectors.filter(F.col(vector).isNotNull()).select(key, vector, *([is_query] if is_query else []))
    joined = assigned.select(key, F.col("shard_id").cast("long")).join(found, key)
    # a stated number of partitions, so that small shards are not gathered in one task
    dealt = joined.repartition(max(1, 4 * n_shards), "shard_id")
    return dealt.groupBy("shard_id").applyInPandas(one, "shard_id long, id long, neighbours array<long>, is_start boolean")


def beam_search(graph: DataFrame, vectors: DataFrame, queries: np.ndarray, k: int, width: int = 100, key: str = "vec_id", vector: str = "embedding", dead: str | None = None, scales: np.ndarray | None = None, descriptors: str | None = None, quantizer: ProductQuantizer | None = None, query_ids: np.ndarray | None = None, beam: int = 3) -> DataFrame:
    """``query_id, vec_id, score, rank`` by search in every shard's graph, ``beam`` nodes a step.

    A query's id is its place, or that of ``query_ids``.

    Dead nodes are passed through but not returned.  ``scales`` weigh the descriptor codes, which
    are added to scores.  With a ``quantizer`` the search is steered by codes and results are scored exactly.
    """
    extra = [c for c in (dead, descriptors) if c]
    named = np.arange(len(queries)) if query_ids is None else query_ids
    k_best = k  # a shard's rows beyond its own best are never among the best of all

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        x, ids = np.stack(rows[vector].to_numpy()).astype(np.float32), rows["id"].to_numpy()
        asked, codes = queries, quantizer.encode(x) if quantizer else None
        bias = np.zeros(len(x))
        if scales is not None:
            bias = np.stack(rows[descriptors].to_numpy()).astype(np.float64) @ scales
        if scales is not None:  # an extra dimension per descriptor makes the bias part of the product
            x = np.hstack([x, np.stack(rows[descriptors].to_numpy()).astype(np.float32)])
            asked = np.hstack([queries, np.tile(scales, (len(queries), 1))])
        sizes = rows["neighbours"].map(len).to_numpy()
        flat = np.concatenate(rows["neighbours"].to_list()).astype(np.int64)
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        matrix = np.full((len(x), max(1, sizes.max())), -1)
        matrix[np.repeat(np.arange(len(x)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(ids[place] == flat, place, -1)
        start = int(rows["is_start"].to_numpy().argmax())
        gone = rows[dead].to_numpy(bool) if dead else np.zeros(len(ids), bool)
        wide, out = x.astype(np.float64), []
        for part in range(0, len(asked), 256):
            some = asked[part : part + 256]
            near = np.stack([quantizer.scores(quantizer.table(q), codes) + bias for q in queries[part : part + 256]]) if quantizer else None
            for q, visited in batch_search(wide, matrix, start, some, width, beam, near):
                score, known = wide[visited] @ some[q], ~gone[visited]
                order = np.lexsort((ids[visited], -score))
                order = order[known[order]][:k_best]
                out.append((np.full(len(order), named[part + q]), ids[visited[order]], score[order]))
        if not out:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), key: np.empty(0, np.int64), "score": np.empty(0)})
        return pd.DataFrame(dict(zip(["query_id", key, "score"], map(np.concatenate, zip(*out, strict=True)), strict=True)))

    joined = graph.join(vectors.select(F.col(key).alias("id"), vector, *extra), "id")
    found = joined.groupBy("shard_id").applyInPandas(one, f"query_id long, {key} long, score double")
    best = found.groupBy("query_id", key).agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_graph(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``src, dst, score, place``: each vector's ``k`` nearest others, exactly; blocks of vectors are multiplied with all."""
    found = block_top_k(vectors, vectors.withColumnRenamed(key, "query_id"), k + 1, key, vector=vector).filter(F.col("query_id") != F.col(key))
    # without itself, a vector's rank moves up by one behind where it stood
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return found.withColumn("place", place).filter(F.col("place") <= k).select(F.col("query_id").alias("src"), F.col(key).alias("dst"), "score", "place")


def degree_stats(nodes: DataFrame, edges: DataFrame, key: str = "vec_id") -> DataFrame:
    """Mean, upper median, least and greatest number of out-neighbours of all nodes, those without any included."""
    out = edges.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("degree"))
    degrees = nodes.select(key).join(out, key, "left").select(F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    # a row per degree, of which there are no more than a node has neighbours
    each = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy())})
    return each.agg(
        (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("degree"))).alias("median"),
        F.min("degree").alias("least"), F.max("degree").alias("greatest"),
    )


def stitch(edges: DataFrame, vectors: DataFrame, queries: DataFrame, most: int = 16, degree: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``src, dst, added``: the base vectors' edges after queries have passed on their own.

    ``edges`` has ``src, dst`` with base and query nodes; ``queries`` has the ids of query nodes.  Edges to queries are
    dropped.  Then, for one query after another by id, each base vector that pointed at it takes the query's
    out-neighbours, by inner product with the base vector, from the best on: up to ``most`` that it lacks, and only while
    it has fewer than ``degree`` edges.  A base vector is offered at most ``degree`` squared, which bounds its array.
    """
    q = queries.select(F.col(key).alias("query")).distinct()
    plain = edges.select("src", "dst").distinct()
    base = plain.join(q, F.col("src") == F.col("query"), "left_anti")
    kept = base.join(q, F.col("dst") == F.col("query"), "left_anti").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("own"))
    into = base.join(q, F.col("dst") == F.col("query")).select(F.col("src").alias("base"), "query")
    offered = into.join(plain.select(F.col("src").alias("query"), F.col("dst").alias("to")), "query").filter("base != to")
    of = lambda name, to: vectors.select(F.col(key).alias(name), F.col(vector).alias(to))
    offered = offered.join(of("base", "_x"), "base").join(of("to", "_y"), "to")
    offers = offered.groupBy(F.col("base").alias("src")).agg(F.array_sort(F.collect_list(F.struct("query", (-dot("_x", "_y")).alias("far"), "to"))).alias("offers"))
    both = kept.join(offers, "src", "full").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    begin = F.struct(F.array().cast("array<long>").alias("new"), F.lit(None).cast("long").alias("query"), F.lit(0).alias("n"))

    def take(state, offer):
        n = F.when(state["query"].eqNullSafe(offer["query"]), state["n"]).otherwise(0)
        lacks = ~F.array_contains(F.col("own"), offer["to"]) & ~F.array_contains(state["new"], offer["to"])
        room = (n < most) & (F.size("own") + F.size(state["new"]) < degree)
        more = lacks & room
        return F.struct(
            F.when(more, F.concat(state["new"], F.array(offer["to"]))).otherwise(state["new"]).alias("new"),
            offer["query"].cast("long").alias("query"), (n + F.when(more, 1).otherwise(0)).cast("int").alias("n"),
        )

    done = both.select("src", "own", F.when(F.col("offers").isNull(), F.array().cast("array<long>")).otherwise(F.aggregate("offers", begin, take)["new"]).alias("new"))
    tagged = lambda c, added: F.transform(c, lambda v: F.struct(v.alias("dst"), F.lit(added).alias("added")))
    return done.select("src", F.inline(F.concat(tagged("own", False), tagged("new", True))))
