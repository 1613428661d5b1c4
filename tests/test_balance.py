"""Balanced shards, annealed centroids, additive and one-bit codecs, quantiles of hot values."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import additive, order, quantize, ranking, search, shards, stats
from tessera.streaming import flows


def frame(spark, x, parts=3):
    return spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)


def centroids_of(spark, c):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(c)], "shard_id long, centroid array<double>")


def plain_fold(x, keys, c, fudge, n=2):
    counts, out = np.zeros(len(c)), {}
    for seen, k in enumerate(keys, 1):
        scores = [sum(float(a) * float(b) for a, b in zip(x[k], s, strict=True)) - fudge * (m / seen) for s, m in zip(c, counts, strict=True)]
        best = sorted(range(len(c)), key=lambda j: (-scores[j], j))[:n]  # noqa: B023
        counts[best] += 1
        out |= {(k, choice): j for choice, j in enumerate(best, 1)}
    return out, counts


@pytest.fixture(scope="module")
def lopsided():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((240, 8)) * 0.5 + 0.7 * np.eye(8)[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.eye(8)[:5]


@pytest.mark.parametrize("lane_rows", [1_000, 50])
def test_balance_is_a_fold_over_records(spark, lopsided, lane_rows):
    x, c = lopsided
    got = {(r.vec_id, r.choice): r.shard_id for r in shards.balanced_shards(frame(spark, x, 7), centroids_of(spark, c), 1.0, lane_rows).collect()}
    lanes, want = -(-len(x) // lane_rows), {}
    for lane in range(lanes):
        want |= plain_fold(x, range(lane, len(x), lanes), c, 1.0)[0]
    assert got == want
    plain = {(r.vec_id, r.choice): r.shard_id for r in shards.nearest_shards(frame(spark, x), centroids_of(spark, c)).collect()}
    sizes = lambda deal: np.bincount(list(deal.values()), minlength=5)
    assert got != plain and sizes(got).max() - sizes(got).min() < 0.6 * (sizes(plain).max() - sizes(plain).min())


def test_balance_lasts_over_batches_and_restarts(spark, lopsided, tmp_path):
    x, c = lopsided
    parts = [list(range(k, 240, 3)) for k in range(3)]
    for name, together in (("broken", False), ("whole", True)):
        at = f"file://{tmp_path}/{name}"
        run = lambda: flows.append(flows.balanced(flows.source(spark, f"{at}/in", "vec_id long, embedding array<double>", 1), centroids_of(spark, c), 0.5, lanes=2), f"{at}/out", f"{at}/c").awaitTermination()  # noqa: B023, E731
        for ids in parts:
            spark.createDataFrame([(k, x[k].tolist()) for k in ids], "vec_id long, embedding array<double>").coalesce(1).write.mode("append").parquet(f"{at}/in")
            if not together:
                run()
        run()
    got, whole = ({(r.vec_id, r.choice): r.shard_id for r in spark.read.parquet(f"file://{tmp_path}/{n}/out").collect()} for n in ("broken", "whole"))
    want = {}
    for lane in range(2):
        want |= plain_fold(x, [k for ids in parts for k in ids if k % 2 == lane], c, 0.5)[0]
    assert got == whole == want


def test_null_vectors_are_left_out_or_stay_null(spark, lopsided):
    x, c = lopsided
    v = frame(spark, [*x[:5], None])
    assert {r.vec_id for r in shards.balanced_shards(v, centroids_of(spark, c)).collect()} == set(range(5))
    assert shards.balanced_shards(v.limit(0), centroids_of(spark, c)).count() == 0
    pq = quantize.train_pq(x, 2, 4)
    assert {r.vec_id for r in quantize.pq_encode(v, pq).filter("codes IS NULL").collect()} == {5}
    model = ranking.ScoreModel(np.ones((3, 8)), np.zeros(3), np.ones((2, 3)))
    assert [r.vec_id for r in ranking.scored(v, model).filter("scores IS NULL").collect()] == [5]
    assert quantize.decoded_error(v, {"pq": pq}).first().n == 5
    assert quantize.one_bit_codes(v, quantize.OneBitQuantizer(np.zeros(8))).count() == 5


def test_annealing_evens_shards_out(spark, lopsided):
    x, c = lopsided
    v, start = frame(spark, x), centroids_of(spark, c)
    found, least = shards.annealed_centroids(v, start, rounds=12)
    again, same = shards.annealed_centroids(v, start, rounds=12)
    assert least == same and [r.centroid for r in found.collect()] == [r.centroid for r in again.collect()]
    sizes = {(r.choice, r.shard_id): r.n for r in shards.shard_sizes(shards.nearest_shards(v, found)).collect()}
    gap = max(abs(sizes.get((choice, s), 0) - len(x) / 5) for choice in (1, 2) for s in range(5))
    first = shards.spill_counts(v, c[None])[0]
    assert gap == least < np.abs(first - len(x) / 5).max() / 2


def test_two_stage_codes_equal_brute_force():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((250, 6))
    pairs = np.array(list(product(range(5), repeat=2)))
    for model in (additive.ResidualQuantizer.train(x, 2, 5, beam=25), additive.LocalSearchQuantizer.train(x, 2, 5)):
        best = ((x[:, None] - model.decode(pairs)[None]) ** 2).sum(2).min(1)
        assert np.allclose(model.errors(x, model.encode(x)), best, atol=1e-9)
        assert np.array_equal(np.concatenate([model.encode(p) for p in np.array_split(x, 7)]), model.encode(x))


def test_local_search_ends_where_no_change_helps():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 12))
    model = additive.LocalSearchQuantizer.train(x, 4, 6)
    codes = model.encode(x)
    least = model.errors(x, codes)
    for m, c in product(range(4), range(6)):
        other = codes.copy()
        other[:, m] = c
        assert (model.errors(x, other) >= least - 1e-9).all()
    rq, beamless = additive.ResidualQuantizer(model.books, 16), additive.ResidualQuantizer(model.books, 1)
    assert least.mean() <= rq.errors(x, rq.encode(x)).mean() <= beamless.errors(x, beamless.encode(x)).mean()


def test_product_codecs_and_their_order():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)) @ rng.standard_normal((16, 16))
    errors = quantize.compared(x, 4, 8)
    assert errors["lsq"] < errors["rq"] < errors["pq"] and errors["plsq"] <= errors["prq"] < errors["pq"]


def test_one_bit_codes_are_searched_in_the_jvm(spark):
    rng = np.random.default_rng(5)
    for d in (64, 100):
        x = rng.standard_normal((300, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        v = frame(spark, x)
        q = quantize.OneBitQuantizer(x.mean(0))
        coded = quantize.one_bit_codes(v, q)
        got = {r.vec_id: r.e for r in coded.select("vec_id", quantize.one_bit_estimate(q, x[3]).alias("e")).collect()}
        bits, norms, align = q.encode(x)
        step = np.ptp(q.turn @ x[3]) / 15
        assert np.abs(np.array([got[k] for k in range(300)]) - q.scores(x[3], bits, norms, align)).max() < step * 2
        one = [r.vec_id for r in quantize.one_bit_top_k(coded, v, x[3], q, 5, widen=60).collect()]
        assert one == [r.vec_id for r in search.batch_top_k(v, v.filter("vec_id = 3").withColumnRenamed("vec_id", "query_id"), 5).orderBy("rank").collect()]
        asked = v.filter("vec_id < 30").withColumnRenamed("vec_id", "query_id")
        truth = {(r.query_id, r.vec_id) for r in search.batch_top_k(v, asked, 5).collect()}
        assert len({(r.query_id, r.vec_id) for r in quantize.one_bit_batch_top_k(coded, v, asked, q, 5, widen=16).collect()} & truth) >= 0.9 * len(truth)


def test_hadamard_is_a_rotation():
    h = quantize.hadamard(64)
    assert np.allclose(h @ h.T, np.eye(64))


def test_quantiles_of_a_hot_value(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(4_000) < 0.5, 0.0, rng.standard_normal(4_000))
    rows = [(k % 3 if k % 7 else None, float(v) if k % 11 else None) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(6)
    levels = [0.0, 0.1, 0.25, 0.5, 0.501, 0.75, 0.9999, 1.0]
    for cells in (4_096, 7):
        monkeypatch.setattr(order, "CELLS", cells)
        got = {r.g: r.quantiles for r in order.quantiles(df, "x", levels, ["g"]).collect()}
        for g in (0, 1, 2, None):
            assert got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], levels))
        assert order.quantiles(df, "x", levels).first().quantiles == pytest.approx(np.quantile([v for _, v in rows if v is not None], levels))
    assert order.quantiles(df.limit(0), "x", levels, ["g"]).count() == 0


def test_no_task_holds_a_hot_value(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1)).alias("x"))
    placed = order.running(df.groupBy("x").agg(F.count(F.lit(1)).alias("n")), {"upto": F.col("n")}, [F.col("x")])
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2] and placed.agg(F.max("upto")).first()[0] == 100_000


def test_dimension_bounds_are_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 3))
    got = {r.pos: (r.low, r.high) for r in stats.dimension_bounds(frame(spark, x), 0.01, 0.99).collect()}
    assert got == {k: pytest.approx(tuple(np.quantile(x[:, k], [0.01, 0.99]))) for k in range(3)}


def test_query_aware_codes_miss_less_of_what_queries_see(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8))
    asked = rng.standard_normal((60, 8)) * np.array([3.0, 2, 1, 0.3, 0.1, 0.1, 0.1, 0.1])
    moment = quantize.query_moment(frame(spark, [*asked, None]))
    assert np.allclose(moment, asked.T @ asked / 60)
    plain = quantize.train_pq(x, 4, 8)
    aware = quantize.query_aware(plain, x, moment)
    got = quantize.query_error(frame(spark, [*x, None]), {"plain": plain, "aware": aware}, moment).first()
    for name, model in (("plain", plain), ("aware", aware)):
        rest = x - model.decode(model.encode(x))
        assert got[name] == pytest.approx(((rest @ asked.T) ** 2).mean())
    assert got.n == 400 and got.aware < 0.8 * got.plain
    assert np.allclose(aware.transform @ aware.transform.T, np.eye(8))


def test_nearest_shards_multiply_matrices(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    c = spark.createDataFrame([(9, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.0])], "shard_id int, centroid array<double>")
    near = shards.nearest_shards(v, c)
    assert [f.dataType.simpleString() for f in near.schema] == ["int", "int", "bigint", "double"]
    want = [(1, 5, 1, 1.0), (1, 9, 2, 1.0), (2, 2, 1, 1.0), (2, 5, 2, 0.0), (4, 2, 1, 0.5), (4, 5, 2, 0.5)]
    assert sorted(tuple(r) for r in near.collect()) == want
    assert "NestedLoop" not in near._jdf.queryExecution().toString()
