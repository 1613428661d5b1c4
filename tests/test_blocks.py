"""Block joins: exact scores, blocks of any size, copies, nulls, and what the plan reads and collects."""

import numpy as np
import pytest

from tessera.operators import blocks, dedup, graph, search, shards


def frame(spark, x, key="vec_id", parts=5):
    return spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], f"{key} long, embedding array<double>").repartition(parts)


def fold(a, b):
    s = 0.0
    for p, q in zip(a, b, strict=True):
        s += float(p) * float(q)
    return s


def plain(x, q, k):
    return {(i, j, r): s for i, v in enumerate(q) for r, (s, j) in enumerate(sorted(((fold(v, w), j) for j, w in enumerate(x)), key=lambda t: (-t[0], t[1]))[:k], 1)}


@pytest.mark.parametrize("rows", [7, 40, 10_000])
def test_top_k_does_not_depend_on_blocks(spark, rows):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 16))
    x[30:60] = x[5]  # a third are copies
    q = np.concatenate([x[:20], rng.standard_normal((30, 16))])
    found = blocks.block_top_k(frame(spark, x), frame(spark, q, "query_id"), 6, rows=rows).collect()
    assert {(r.query_id, r.vec_id, r["rank"]): r.score for r in found} == plain(x, q, 6)


def test_both_roads_of_batch_search_agree_to_the_last_bit(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 33))
    v, q = frame(spark, x), frame(spark, x[:70], "query_id")
    sent = sorted(map(tuple, search.batch_top_k(v, q, 5).collect()))
    monkeypatch.setattr(search, "MAX_QUERIES", 10)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 30)
    assert sorted(map(tuple, search.batch_top_k(v, q, 5).collect())) == sent and len(sent) == 350


def test_nulls_and_nothing(spark):
    v = frame(spark, [[1.0, 0.0], None, [0.0, 1.0]])
    asked = v.withColumnRenamed("vec_id", "query_id")
    assert sorted((r.query_id, r.vec_id) for r in blocks.block_top_k(v, asked, 1).collect()) == [(0, 0), (2, 2)]
    assert blocks.block_top_k(v.limit(0), asked, 1).count() == 0
    assert {r.vec_id for r in search.novel(v, v.limit(0).unionByName(frame(spark, [[1.0, 0.0]])), 0.5).select("vec_id").collect()} == {2}
    assert {tuple(r) for r in dedup.near_classes(v, 0.5).collect()} == {(0, 0, 0), (2, 2, 0)}


def test_threshold_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 24))
    threshold = fold(x[3], x[7])  # a pair that is not above it, if only just
    want = {i: sum(fold(a, b) > threshold for j, b in enumerate(x) if i != j) for i, a in enumerate(x)}
    for block in (9, 1_000):
        assert {r.vec_id: r.links for r in dedup.near_classes(frame(spark, x), threshold, block=block).collect()} == want


def test_a_key_that_repeats_fills_no_block(spark):
    one = spark.createDataFrame([(5, [1.0, float(k)]) for k in range(1_000)], "vec_id long, embedding array<double>").repartition(4)
    sizes = [r["count"] for r in blocks._dealt(one, "vec_id", "embedding", 10).groupBy("own").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200


def test_the_table_is_read_twice_and_never_collected(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    frame(spark, rng.standard_normal((300, 8))).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    taken = []
    for name in ("toArrow", "collect", "toPandas", "toLocalIterator"):
        whole = getattr(type(v), name)
        monkeypatch.setattr(type(v), name, lambda self, *a, whole=whole, **k: taken.append(1) or whole(self, *a, **k))
    for plan in (graph.knn_graph(v, 4), search.novel(v.filter("vec_id % 3 = 0"), v.filter("vec_id % 3 != 0"), 0.5)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") <= 3 and not taken
    dedup.near_classes(v, 0.5)
    assert not taken


def test_routed_search_with_all_shards_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12))
    v, asked = frame(spark, x), frame(spark, x[:25], "query_id")
    centroids = shards.spherical_kmeans(v, 9)
    assigned = shards.nearest_shards(v, centroids).select("vec_id", "shard_id").join(v, "vec_id")
    exact = {(r.query_id, r.vec_id, r["rank"], r.score) for r in search.batch_top_k(v, asked, 5).collect()}
    for chunk in (20, 10_000):
        got = {(r.query_id, r.vec_id, r["rank"], r.score) for r in search.routed_top_k(assigned, asked, centroids, 5, probes=9, chunk=chunk).collect()}
        assert got == exact
    few = search.routed_top_k(assigned, asked, centroids, 5, probes=3).collect()
    assert len({(r.query_id, r.vec_id) for r in few} & {(q, n) for q, n, *_ in exact}) >= 0.7 * len(exact)


def test_a_matrix_file_is_read_in_ranges(spark, tmp_path):
    from tessera.sources.files import fp16_matrix

    x = np.random.default_rng(6).standard_normal((1_003, 6)).astype("<f2")
    (tmp_path / "a.bin").write_bytes(x.tobytes() + b"abc")
    (tmp_path / "b.bin").write_bytes(x[:5].tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    df = fp16_matrix(spark, f"file://{tmp_path}", 6, split_rows=100)
    assert df.rdd.getNumPartitions() == 12
    rows = {(r.file.rsplit("/", 1)[1], r.row): r.embedding for r in df.collect()}
    assert len(rows) == 1_008 and all(np.array_equal(np.array(v, "<f2"), x[k]) for (_, k), v in rows.items())
    assert fp16_matrix(spark, str(tmp_path / "c.bin"), 6).count() == 0
