import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import dot, query_vector, sign_code, to_matrix
from tessera.operators import dedup, graph, incremental, quantize, ranking, search, shards, sinks, stats
from tessera.sources import dump, files, listing
from tessera.streaming import flows


def vectors(spark, n=200, d=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")


def test_batch_top_k_equals_declarative(spark):
    x, v = vectors(spark)
    asked = v.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    found = {(r.query_id, r.rank): r.vec_id for r in search.batch_top_k(v, asked, 7).collect()}
    for q in range(5):
        one = v.filter(f"vec_id = {q}").select(F.col("embedding").alias("query"))
        assert [found[q, k + 1] for k in range(7)] == [r.vec_id for r in search.top_k(v, one, 7).collect()]


def test_batch_top_k_in_blocks(spark, monkeypatch):
    x, v = vectors(spark, 60, 8)
    asked = v.withColumnRenamed("vec_id", "query_id")
    rank = lambda: sorted(map(tuple, search.batch_top_k(v, asked, 2).collect()))
    whole = rank()
    monkeypatch.setattr(search, "MAX_QUERIES", 25)
    assert rank() == whole and len(whole) == 120


def test_batch_top_k_keeps_ties_by_key(spark):
    v = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(50)], "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert sorted(r.vec_id for r in search.batch_top_k(v, q, 3).collect()) == [0, 1, 2]


def test_encoder_is_needed_for_text(spark):
    schema = "embedding array<float>, image string, text string, predefined_embedding string, weight double"
    named = spark.createDataFrame([("a", [1.0, 2.0])], "name string, embedding array<float>")
    terms = spark.createDataFrame([([0.5, 0.5], None, "hello", "a", -2.0)], schema)
    with pytest.raises(ValueError):
        search.total_query(terms, named)
    got = search.total_query(terms, named, lambda kind: lambda values: np.array([[len(v), 0.0] for v in values])).first()["query"]
    assert got == [-2.0 * (0.5 + 1.0 + 5.0), -2.0 * (0.5 + 2.0)]


def test_random_query_is_seeded():
    assert search.random_query(8, 1) == search.random_query(8, 1) != search.random_query(8, 2)


def test_sign_code_of_zero(spark):
    assert spark.createDataFrame([([0.0, -1.0, 2.0],)], "e array<double>").select(sign_code("e")).first()[0] == "001"


def test_greedy_near_dup_keeps_the_best(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.8, [0.99, 0.1]), (0, 3, 0.7, [0.0, 1.0]), (1, 2, 0.8, [0.99, 0.1])]
    r = spark.createDataFrame(rows, "query_id long, vec_id long, score double, embedding array<double>")
    assert sorted((x.query_id, x.vec_id) for x in dedup.greedy_near_dup(r, 0.95).collect()) == [(0, 1), (0, 3), (1, 2)]


def test_product_quantizer_codes_by_inner_product():
    books = np.array([[[1.0, 0.0], [10.0, 0.0]], [[0.0, 1.0], [0.0, -1.0]]])
    q = quantize.ProductQuantizer(books)
    # by distance the first codeword would win the first part
    assert q.encode(np.array([[1.0, 0.1, 0.0, 2.0]])).tolist() == [[1, 0]]
    table = q.table(np.array([1.0, 0.0, 0.0, 1.0]))
    assert q.scores(table, np.array([[1, 0]]))[0] == pytest.approx(11.0)


def test_learned_rotation_is_orthonormal_and_helps():
    x = np.random.default_rng(0).standard_normal((400, 16)) @ np.random.default_rng(1).standard_normal((16, 16))
    m = quantize.train_pq(x, 4, 16, rounds=6)
    assert np.allclose(m.transform @ m.transform.T, np.eye(16))
    aware = quantize.train_pq(x, 4, 16, rounds=6, queries=x[:50])
    assert np.allclose(aware.transform @ aware.transform.T, np.eye(16))


def test_chain_encoding_is_the_cheapest():
    books = np.random.default_rng(0).standard_normal((3, 3, 4))
    m = quantize.ChainQuantizer(books)
    x = np.random.default_rng(1).standard_normal((5, 4))
    def cost(p, c):
        v = [books[s, c[s]] for s in range(3)]
        return sum((a**2).sum() - 2 * a @ p for a in v) + 2 * (v[0] @ v[1] + v[1] @ v[2])
    import itertools
    for p, c in zip(x, m.encode(x), strict=True):
        assert cost(p, c) == pytest.approx(min(cost(p, k) for k in itertools.product(range(3), repeat=3)))


def test_graph_degrees_and_recall():
    x = np.random.default_rng(0).standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, start = graph.build(x, degree=12, width=40, most=100, passes=2)
    assert max(map(len, lists)) <= 12
    hits = 0
    for q in range(20):
        found, _ = graph.greedy_search(x, lists, start, x[q], 60)
        hits += len({*found[:10]} & {*np.argsort(-(x @ x[q]))[:10].tolist()})
    assert hits / 200 >= 0.9


def test_beam_search_hides_dead_rows_and_adds_descriptors(spark):
    x, v = vectors(spark, 60, 8)
    v = v.withColumn("dead", F.col("vec_id") == 3).withColumn("codes", F.array((F.col("vec_id") == 9).cast("double") * 255))
    g = graph.build_graphs(v.select("vec_id", F.lit(0).alias("shard_id")), v, degree=8, width=30, most=50, passes=1)
    assert 3 not in {r.vec_id for r in graph.beam_search(g, v, x[3:4], 10, 60, dead="dead").collect()}
    best = graph.beam_search(g, v, x[3:4], 1, 60, scales=np.array([1.0]), descriptors="codes").first()
    assert best.vec_id == 9


def test_balanced_shards_are_more_even(spark):
    x, v = vectors(spark, 300, 8)
    v = v.select("vec_id", F.transform("embedding", lambda e: e + 0.3).alias("embedding"))
    c = spark.createDataFrame([(k, [0.3 + 0.2 * (k == j) for j in range(8)]) for k in range(4)], "shard_id long, centroid array<double>")
    even = lambda a: a.groupBy("shard_id").count().agg(F.max("count") - F.min("count")).first()[0]
    one = v.coalesce(1)
    dealt = shards.balanced_shards(one, c, fudge=2.0, batch=16)
    assert dealt.count() == 600 and dealt.groupBy("vec_id").count().filter("count != 2").count() == 0
    assert even(dealt) <= even(shards.nearest_shards(v, c))


def test_work_plan_cases(spark):
    disk = spark.createDataFrame([("new", 10), ("old", 10), ("same", 10), ("nometa", 10)], "filename string, mtime long")
    stored = spark.createDataFrame([("old", 5, 20, 20, 1), ("same", 10, 10, 10, 1), ("nometa", 10, 10, 10, None)], "filename string, embedding_time long, ocr_time long, thumbnail_time long, metadata int")
    got = {r.filename: (r.needs_embed, r.needs_ocr, r.needs_thumbnail, r.needs_metadata) for r in incremental.work_plan(disk, stored).collect()}
    assert got == {"new": (True,) * 4, "old": (True, False, False, True), "nometa": (False, False, False, True)}


def test_merge_keeps_values_that_a_change_lacks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, p string")
    assert sorted(map(tuple, incremental.merge(old, new, "k").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_histogram_edges(spark):
    d = spark.createDataFrame([(-2.0,), (-1.0,), (0.999,), (1.0,), (5.0,)], "x double")
    assert [r[0] for r in d.select(stats.fixed_bin(F.col("x"))).collect()] == [0, 0, 511, 511, 511]


def test_auroc_with_ties_and_one_label(spark):
    d = spark.createDataFrame([(1.0, True), (1.0, False)], "s double, y boolean")
    assert stats.auroc(d, "s", "y").first()[0] == 0.5
    assert stats.auroc(d.filter("y"), "s", "y").first()[0] is None


def test_score_model_is_its_ensembles_mean(tmp_path):
    rng = np.random.default_rng(0)
    members = [ranking.ScoreModel(rng.standard_normal((6, 4)), rng.standard_normal(6), rng.standard_normal((2, 6))) for _ in range(3)]
    wide, x = ranking.ScoreModel.widen(members), rng.standard_normal((5, 4))
    assert np.allclose(wide(x), np.mean([m(x) for m in members], 0))
    wide.save(f"{tmp_path}/m.npz")
    assert np.allclose(ranking.ScoreModel.load(f"{tmp_path}/m.npz")(x), wide(x))


def test_sparse_features_keep_values_above_the_kth():
    m = ranking.SparseAutoencoder(np.eye(4), np.zeros(4), np.eye(4), np.zeros(4), 2)
    assert m.features(np.array([[3.0, 1.0, 2.0, -5.0]])).tolist() == [[3.0, 0.0, 2.0, 0.0]]


def test_content_types(spark):
    rows = [("image/png", 10, False, True), ("text/html", 10, False, False), ("text/html; x", 10, True, True), ("image/png", 1 << 25, False, False), ("video/mp4", 1, True, False)]
    d = spark.createDataFrame(rows, "k string, n long, h boolean, want boolean")
    assert all(r[0] == r[1] for r in d.select(T.content_accepted(F.col("k"), F.col("n"), F.col("h")), "want").collect())


def test_timestamps(spark):
    d = spark.createDataFrame([("12", 12), ("12.9", 12), ("soon", None), (None, None)], "s string, want long")
    assert all(r[0] == r[1] for r in d.select(T.epoch_seconds(F.col("s")), "want").collect())


def test_query_vector_round_trip():
    import base64

    x = np.array([0.5, -2.0, 1.0], "<f2")
    assert query_vector(base64.urlsafe_b64encode(x.tobytes()).decode().rstrip("=")).tolist() == [0.5, -2.0, 1.0]


def test_fp16_files_and_scan(spark, tmp_path):
    x = np.arange(12, dtype="<f2").reshape(3, 4)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(x.tobytes() + b"\x00")
    rows = files.fp16_matrix(spark, f"file://{tmp_path}/in", 4).orderBy("row").collect()
    assert [r.embedding for r in rows] == x.astype(float).tolist()
    assert [(r.filename, r.size) for r in files.scan(spark, f"file://{tmp_path}/in", ["bin"]).collect()] == [("a.bin", 25)]


def test_listing_follows_cursors(spark, tmp_path):
    for name, after, items in (("first", "c1", [1, 2]), ("c1", "c2", [3]), ("c2", None, [4])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"items": items, "after": after}))
    listing.register(spark)
    rows = spark.read.format("listing").load(str(tmp_path)).collect()
    assert [(r.cursor, r.item) for r in rows] == [("first", "1"), ("first", "2"), ("c1", "3"), ("c2", "4")]


def test_dumps_logs_and_samples(spark, tmp_path):
    d = spark.range(5)
    sinks.append_dump(d, f"{tmp_path}/dump", 3)
    sinks.append_dump(d, f"{tmp_path}/dump", 3)
    assert spark.read.parquet(f"{tmp_path}/dump").count() == 5
    (tmp_path / "log").write_text('{"config":1}\n{"loss":0.5,"step":1,"time":2.0}\n{"step":2,"time":3.0,"val_loss":{"a":0.1}}\n')
    assert files.training_log(spark, f"{tmp_path}/log").count() == 2
    (tmp_path / "s").write_text('{"url":"u","timestamp":1,"title":"a"}\n{"url":"u","timestamp":2,"title":"b"}\n')
    assert [r.title for r in files.sample_records(spark, f"{tmp_path}/s").collect()] == ["b"]
    schema = "url string, timestamp long, title string"
    assert files.newer_inputs(spark, f"{tmp_path}/s", "r", schema).count() == 2
    assert files.newer_inputs(spark, f"{tmp_path}/s", "s", schema).count() == 0


def test_shards_are_written_by_folder(spark, tmp_path):
    shards.write_shards(spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "vec_id long, shard_id long"), f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").filter("shard_id = 1").count() == 2


def test_shuffle_is_stable(spark):
    a, b = ([r.id for r in sinks.shuffled(spark.range(50).repartition(n), "id", 1).collect()] for n in (1, 7))
    assert a == b != sorted(a)


def test_repeated_batches_do_no_harm(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "k long, n long"
    spark.createDataFrame([(1, 1), (2, 1)], schema).write.parquet(f"{at}/in/a")
    run = lambda: flows.upsert_into(spark.readStream.schema(schema).parquet(f"{at}/in/*"), f"{at}/t", "k", "n", f"{at}/c").awaitTermination()
    run()
    spark.createDataFrame([(2, 2), (3, 1)], schema).write.parquet(f"{at}/in/b")
    run()
    run()
    assert sorted(map(tuple, flows.current(spark, f"{at}/t").collect())) == [(1, 1), (2, 2), (3, 1)]


def test_poll_interval():
    assert flows.poll_interval([]) == 3600 and flows.poll_interval([10.0, 20.0]) == 15


def test_dot_and_matrix(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert d.select(dot("a", "b")).first()[0] == 11.0
    assert to_matrix(d.select("a").toArrow().column(0)).tolist() == [[1.0, 2.0]]


def test_encoder_batches_and_nulls(spark):
    from tessera.operators.encode import encoded

    def encoder(texts):
        assert len(texts) <= 2
        return np.array([[len(t), 0.0] for t in texts])

    d = spark.createDataFrame([(k, None if k == 3 else "x" * (k + 1)) for k in range(7)], "k long, t string").coalesce(1)
    got = {r.k: r.embedding for r in encoded(d, encoder, "k", "t", 2).collect()}
    assert got == {k: None if k == 3 else [1.0, 0.0] for k in range(7)}


def test_coded_search_recall(spark):
    x, v = vectors(spark, 200, 16)
    g = graph.build_graphs(v.select("vec_id", F.lit(0).alias("shard_id")), v, degree=16, width=40, most=80, passes=1)
    model = quantize.train_pq(x, 8, 32, rounds=5)
    found = graph.beam_search(g, v, x[:10], 5, 100, quantizer=model)
    truth = search.batch_top_k(v, v.filter("vec_id < 10").withColumnRenamed("vec_id", "query_id"), 5)
    assert stats.recall(truth, found, 5).first()["recall"] >= 0.9


def test_listing_stream_goes_on(spark, tmp_path):
    """A last page that grows, and then gets a successor, is read on; nothing comes twice."""
    folder, at = tmp_path / "pages", f"file://{tmp_path}"
    folder.mkdir()
    put = lambda name, after, items: (folder / f"{name}.json").write_text(json.dumps({"items": items, "after": after}))
    listing.register(spark)

    def seen():
        stream = spark.readStream.format("listing").option("pages", 2).load(str(folder))
        flows.append(stream, f"{at}/out", f"{at}/checkpoint").awaitTermination()
        return sorted(r.item for r in spark.read.parquet(f"{at}/out").collect())

    put("first", "c1", [1, 2])
    put("c1", None, [3])
    assert seen() == ["1", "2", "3"]
    put("c1", None, [3, 4])
    assert seen() == ["1", "2", "3", "4"]
    put("c1", "c2", [3, 4])
    put("c2", "c3", [5])
    put("c3", None, [6, 7])
    assert seen() == ["1", "2", "3", "4", "5"]  # a batch is two pages
    assert seen() == seen() == ["1", "2", "3", "4", "5", "6", "7"]


def test_listing_offsets_replay(tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"items": [1, 2], "after": "c1"}))
    (tmp_path / "c1.json").write_text(json.dumps({"items": [3, 4], "after": None}))
    stream = listing._Stream(str(tmp_path), 100)
    rows, end = stream.read(stream.initialOffset())
    assert list(rows) == list(stream.readBetweenOffsets(stream.initialOffset(), end)) and end == {"cursor": "c1", "seen": 2}
    assert list(stream.readBetweenOffsets({"cursor": "c1", "seen": 1}, end)) == [("c1", "4")]
    assert list(stream.read(end)[0]) == []


def test_rows_without_a_url_are_no_copies(spark):
    d = spark.createDataFrame([(1, None, [1.0, -1.0]), (2, None, [-1.0, 1.0]), (3, "u", [1.0, 1.0]), (4, "u", [-1.0, -1.0]), (5, "v", None), (6, "w", None)], "vec_id long, url string, embedding array<double>")
    assert sorted(r.vec_id for r in dedup.ingest_dedup(d).collect()) == [1, 2, 3, 5, 6]


def test_masks_of_too_many_formats_are_refused(spark):
    many = lambda n: spark.createDataFrame([(1, [f"f{k:02d}" for k in range(n)])], "k long, formats array<string>")
    assert sinks.format_mask(many(62), "k", "formats")[0].first().mask == sum(1 << k for k in range(1, 63))
    with pytest.raises(ValueError):
        sinks.format_mask(many(63), "k", "formats")


def test_unique_names_pass_over_names_that_exist(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-4"), (6, "a-2"), (7, "a")], "k long, name string")
    got = {r.k: r.unique_name for r in incremental.unique_names(d, "name", "k").collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-5", 5: "a-4", 6: "a-2-2", 7: "a-6"}


def test_null_and_uneven_vectors_are_not_shifted(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        to_matrix(v.select("embedding").toArrow().column(0))
    with pytest.raises(ValueError):
        to_matrix(spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],)], "e array<double>").toArrow().column(0))
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in search.batch_top_k(v, q, 1).collect()] == [(9, 1)]
    assert ranking.covariance(v).count() == 3


def test_the_last_of_equals_is_always_the_same(spark):
    rows = [("u", 1, t) for t in "bdca"]
    take = lambda n: incremental.last_by(spark.createDataFrame(rows, "url string, n long, title string").repartition(n), ["url"], "n").first().title
    assert take(1) == take(3) == take(4) == "d"


def test_several_query_rows_are_refused(spark):
    x, v = vectors(spark, 10, 4)
    two = v.limit(2).select(F.col("embedding").alias("query"))
    for ask in (lambda: search.top_k(v, two, 3), lambda: search.route(two, v.select(F.col("vec_id").alias("shard_id"), F.col("embedding").alias("centroid")))):
        with pytest.raises(ValueError):
            ask()


def test_an_empty_request_is_a_random_one(spark):
    schema = "embedding array<float>, image string, text string, predefined_embedding string, weight double"
    named = spark.createDataFrame([("house style", [1.0, 1.0, 0.0, 0.0])], "name string, embedding array<float>")
    none = spark.createDataFrame([], schema)
    default = spark.createDataFrame([(None, None, None, "house style", 0.5)], schema)
    got = search.request_query(none, named, 4, default, seed=3).first()["query"]
    assert got == pytest.approx([a + b for a, b in zip(search.random_query(4, 3), [0.5, 0.5, 0, 0], strict=True)], abs=1e-6)
    assert search.request_query(default, named, 4).first()["query"] == [0.5, 0.5, 0.0, 0.0]


def test_pruning_of_queries_and_saturation():
    x = np.array([[1.0, 0.0], [0.9, 0.4359], [0.89, 0.456], [0.0, -1.0]])
    everyone = np.arange(1, 4)
    assert graph.robust_prune(x, 0, everyone, 3, 1.0).tolist() == [1, 3]
    assert graph.robust_prune(x, 0, everyone, 3, 1.0, saturate=True).tolist() == [1, 3, 2]
    marks = np.array([False, False, True, False])
    assert graph.robust_prune(x, 0, everyone, 3, 1.0, marks, query_alpha=0.5).tolist() == [1, 2, 3]
    assert graph.robust_prune(x, 2, np.array([0, 1, 3]), 3, 1.0, marks).tolist() == [1, 0, 3]  # a query's places are filled


def test_searches_for_queries_pass_base_vectors_only():
    x = np.random.default_rng(2).standard_normal((120, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    marks = np.arange(120) >= 100
    lists, start = graph.build(x, degree=10, width=30, most=60, passes=1, is_query=marks)
    assert not marks[start]
    _, visited = graph.greedy_search(x, lists, start, x[110], 30, ~marks)
    assert not any(marks[v] for v in visited)
    one, wide = (graph.greedy_search(x, lists, start, x[5], 30, beam=b)[0] for b in (1, 4))
    assert one[:5] == wide[:5]


def test_stitching_by_hand(spark):
    """Base 1 points at query 10, which points at 2, 3 and 4: the nearest to 1 come first, as far as there is room."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 1.0]), (3, [0.9, 0.1]), (4, [0.5, 0.5]), (5, [0.0, 1.0]), (10, [1.0, 1.0])], "vec_id long, embedding array<double>")
    e = spark.createDataFrame([(1, 10), (1, 5), (10, 2), (10, 3), (10, 4), (2, 3)], "src long, dst long")
    run = lambda **how: sorted((r.src, r.dst, r.added) for r in graph.stitch(e, v, v.filter("vec_id = 10"), **how).collect())
    kept = [(1, 5, False), (2, 3, False)]
    assert run() == sorted([*kept, (1, 2, True), (1, 3, True), (1, 4, True)])
    assert run(most=2) == sorted([*kept, (1, 3, True), (1, 4, True)])
    assert run(degree=2) == sorted([*kept, (1, 3, True)])
    has = e.union(spark.createDataFrame([(1, 3)], e.schema))
    again = sorted((r.src, r.dst, r.added) for r in graph.stitch(has, v, v.filter("vec_id = 10"), most=1).collect())
    assert again == sorted([*kept, (1, 3, False), (1, 4, True)])  # an edge that is there does not use up the quota


def test_degrees_count_nodes_without_edges(spark):
    nodes = spark.range(5).withColumnRenamed("id", "vec_id")
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 1)], "src long, dst long")
    assert tuple(graph.degree_stats(nodes, e).first()) == (1.2, 1, 0, 3)


def test_large_shards_are_refused(spark):
    x, v = vectors(spark, 30, 8)
    with pytest.raises(ValueError):
        graph.build_graphs(v.select("vec_id", F.lit(0).alias("shard_id")), v, most_bytes=900)


def test_compressed_lines_are_read(spark, tmp_path):
    import zstandard

    line = '{"url":"https://x.com/f.png","over_18":false,"title":"t","author":"u","selftext":"","subreddit":"s","created_utc":5,"id":"a"}'
    (tmp_path / "RS.zst").write_bytes(zstandard.ZstdCompressor().compress(f"{line}\nbroken\n".encode()))
    assert [r.id for r in dump.parse(dump.read_lines(spark, f"file://{tmp_path}/RS.zst")).collect()] == ["a"]


def test_scan_skips_the_output_folder(spark, tmp_path):
    for name in ("in/a.png", "in/b.PNG", "in/c.txt", "in/out/d.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.filename for r in files.scan(spark, f"file://{tmp_path}/in", ["png"], "out/").collect()) == ["a.png", "b.PNG"]


def test_vectors_alone_and_a_queue_are_written(spark, tmp_path):
    x, v = vectors(spark, 20, 4)
    sinks.write_vectors(v, f"{tmp_path}/v")
    back = [np.frombuffer(r.embedding, "<f2") for r in spark.read.parquet(f"{tmp_path}/v").collect()]
    assert np.allclose(sorted(map(tuple, back)), sorted(map(tuple, x)), atol=1e-3)
    pairs = spark.createDataFrame([("p", "q")], "a string, b string")
    for _ in range(2):
        sinks.queued(pairs, f"{tmp_path}/queue", "7")
    assert [(r.meme1, r.meme2, r.iteration) for r in spark.read.parquet(f"{tmp_path}/queue").collect()] == [("p", "q", 7)]


def test_order_without_one_task(spark):
    from tessera.operators import order

    d = spark.range(3000).select("id", (F.col("id") % 7 == 0).alias("hot"), F.when(F.col("id") % 3 != 0, F.col("id") % 50).alias("x"))
    got = order.positions(d, [F.col("x"), F.col("id")], ["hot"]).collect()
    for hot in (True, False):
        own = sorted((r.place, r.x, r.id, r.total) for r in got if r.hot == hot)
        assert [o[0] for o in own] == list(range(len(own))) and {o[3] for o in own} == {len(own)}
        assert [o[1:3] for o in own] == sorted((o[1:3] for o in own), key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    sums = {r.id: r.s for r in order.running(d, {"s": F.col("id")}, [F.col("id")]).collect()}
    assert all(sums[k] == k * (k + 1) // 2 for k in range(3000))
    q = order.quantiles(d, "x", [0.0, 0.123, 0.5, 1.0], ["hot"]).collect()
    for r in q:
        assert r.quantiles == pytest.approx(np.quantile([k % 50 for k in range(3000) if k % 3 and (k % 7 == 0) == r.hot], [0.0, 0.123, 0.5, 1.0]))


def test_rolling_means_cross_blocks(spark):
    d = spark.range(100).select("id", (F.col("id") % 13).alias("x"))
    rows = lambda block: sorted((r.id, round(r.rolling, 9)) for r in stats.rolling_mean(d, "x", "id", 5, block=block).collect())
    assert rows(10) == rows(1000) and len(rows(10)) == 96


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera import storage

    conf = SimpleNamespace(get=lambda key, default=None: default)
    at = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert storage.shared_dir(at("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(at(master))


def test_exemplars_of_components_on_both_sides(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6)) * [5, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    parts, _ = ranking.principal_components(df, 2)
    got = {(r.direction, r.side, r["rank"]): r.vec_id for r in ranking.signed_exemplars(df, parts, 4).collect()}
    for i, part in enumerate(parts):
        order = np.argsort(-(x @ part))
        assert [got[i, "max", k] for k in range(1, 5)] == order[:4].tolist()
        assert [got[i, "min", k] for k in range(1, 5)] == order[::-1][:4].tolist()
    assert len(got) == 16
