"""Packed nodes and the search that reads only what it visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, quantize, search, served, shards


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(k, r.tolist(), k % 50 == 7) for k, r in enumerate(x)] + [(999, None, False)], "vec_id long, embedding array<float>, dead boolean")
    centroids = shards.spherical_kmeans(v.filter("embedding IS NOT NULL"), 3)
    g = graph.build_graphs(shards.nearest_shards(v, centroids), v, degree=12, width=24, most=100, passes=1).persist()
    model = quantize.train_pq(x, 8, 16)
    nodes = served.write_packed(served.packed_nodes(g, v, model, dead="dead"), 4)
    return v, g, g.filter("is_start").select("shard_id", "id"), centroids, model, nodes


def test_nodes_hold_their_neighbours_codes(spark, index):
    v, g, _, _, model, nodes = index
    rows = {r.id: r for r in nodes.collect()}
    lists = {}
    for r in g.collect():
        lists.setdefault(r.id, set()).update(r.neighbours)
    x = {r.vec_id: np.array(r.embedding) for r in v.collect() if r.embedding}
    assert set(rows) == set(x)
    codes = dict(zip(x, model.encode(np.stack(list(x.values()))).tolist(), strict=True))
    for k, r in rows.items():
        assert {n.id: n.code for n in r.neighbours} == {n: codes[n] for n in lists[k]}
        assert np.allclose(np.frombuffer(r.vector, "<f2"), x[k], atol=1e-3)


def test_search_reads_little_and_finds_most(spark, index):
    v, _, starts, centroids, model, nodes = index
    asked = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = served.packed_search(nodes, asked, starts, centroids, model, 5, width=40, probes=2).collect()
    truth = {(r.query_id, r.vec_id) for r in search.batch_top_k(v.filter("NOT dead"), asked, 5).collect()}
    assert len({(r.query_id, r.vec_id) for r in found} & truth) >= 0.9 * len(truth)
    assert max(r.reads for r in found) < 150 and not any(r.vec_id % 50 == 7 for r in found)
    again = served.packed_search(nodes, asked.repartition(7), starts, centroids, model, 5, width=40, probes=2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_a_wide_beam_reads_all_and_is_exact_in_half_precision(spark, index):
    v, _, starts, centroids, model, nodes = index
    asked = v.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    found = served.packed_search(nodes, asked, starts, centroids, model, 3, width=1_000, expand=100, probes=3).collect()
    half = {r.vec_id: np.array(r.embedding, np.float16).astype(float) for r in v.filter("NOT dead AND embedding IS NOT NULL").collect()}
    for r in asked.collect():
        best = sorted(half, key=lambda k: (-half[k] @ np.array(r.embedding), k))[:3]  # noqa: B023
        assert [f.vec_id for f in sorted(found, key=lambda f: f["rank"]) if f.query_id == r.query_id] == best
    assert {f.reads for f in found} == {300}


def test_nothing_asked(spark, index):
    v, _, starts, centroids, model, nodes = index
    none = v.limit(0).select(F.col("vec_id").alias("query_id"), "embedding")
    assert served.packed_search(nodes, none, starts, centroids, model, 3).count() == 0


def test_the_join_moves_the_frontier_not_the_nodes(spark, index):
    nodes = index[-1]
    wanted = spark.range(50).select((F.col("id") % 5).alias("query_id"), F.col("id"))
    plan = wanted.join(nodes.hint("merge"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
