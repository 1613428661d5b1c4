"""Searches of many queries at once visit what one search visits, and find near copies' neighbours too."""

import numpy as np

from tessera.operators import graph


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def families(n=1_200, copies=60, dims=64):
    """Families of near copies, each of more vectors than a node has edges."""
    rng = np.random.default_rng(0)
    return unit(np.repeat(unit(rng.standard_normal((n // copies, dims))), copies, 0) + 0.01 * rng.standard_normal((n, dims)))


def test_batches_visit_what_single_searches_visit():
    x = families()
    lists, start = graph.build(x.astype(np.float32), degree=24, width=48, most=200, passes=1, alpha=1.0)
    matrix = np.full((len(x), max(map(len, lists))), -1)
    for k, own in enumerate(lists):
        matrix[k, : len(own)] = own
    asked = x[::10]
    codes = np.random.default_rng(1).standard_normal((len(asked), len(x)))
    for near in (None, codes):
        for q, visited in graph.batch_search(x, matrix, start, asked, 40, 3, near, batch=50):
            _, alone = graph.greedy_search(x, lists, start, asked[q], 40, approx=None if near is None else near[q], beam=3)
            assert sorted(alone) == visited.tolist()


def test_families_of_near_copies_are_reached(spark, tmp_path):
    from tessera.plans import registry

    x = families()
    rows = [(k, r.tolist(), k // 60 % 10) for k, r in enumerate(x.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.queries()["recall_at_k"](spark, str(tmp_path)).first().at_least_90
