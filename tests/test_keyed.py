"""Keyed tables by buckets, reloads, and upserts with null and repeated keys."""

import os
import threading
import time

from pyspark.sql import functions as F

from tessera.operators import incremental
from tessera.streaming import flows
from tessera.streaming.keyed import KeyedTable, Reloads

SCHEMA = "k long, n long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "n", buckets=16)
    assert t.read() is None
    first = t.apply(spark.range(5_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"), F.repeat(F.lit("x"), 50).alias("v")), 0)
    assert first["buckets"] == 16
    before = files_of(tmp_path / "t")
    small = t.apply(spark.createDataFrame([(7, 2, "new"), (5_001, 1, "added")], SCHEMA), 1)
    assert small["buckets"] <= 2 and small["bytes"] < first["bytes"] / 6
    assert before <= files_of(tmp_path / "t")
    got = t.read()
    assert got.count() == 5_001 and rows(got.filter("k in (7, 5001)")) == [(5001, 1, "added"), (7, 2, "new")]
    assert t.apply(spark.createDataFrame([(7, 9, "again")], SCHEMA), 1) is None and t.read().filter("n = 9").isEmpty()


def test_a_reader_ends_on_the_version_it_began_with(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "n", buckets=4)
    for number in range(4):
        t.apply(spark.createDataFrame([(k, number, f"v{number}") for k in range(number, 10)], SCHEMA), number)
        if number == 1:
            old = t.read()
    assert {r.n for r in old.collect()} == {0, 1} and {r.n for r in t.read().collect()} == {0, 1, 2, 3}
    assert rows(t.read(1)) == rows(old)
    t.forget(keep=2)
    assert t.versions() == [2, 3] and t.read().count() == 10 and t.read(2).count() == 10
    held = files_of(tmp_path / "t")
    assert all(any(f"/data/{v:09d}" in f for f in held) for v in (2, 3)) and not any("/data/000000000/" in f and "_bucket" not in f for f in held)


def test_older_rows_nulls_and_ties(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "n", buckets=4)
    t.apply(spark.createDataFrame([(1, 5, "a"), (None, 1, "x"), (None, 1, "y"), (2, 3, "b"), (2, 3, "c")], SCHEMA), 0)
    t.apply(spark.createDataFrame([(1, 4, "older"), (None, 2, "z"), (None, 2, None)], SCHEMA), 1)
    got = {r.k: r.v for r in t.read().collect()}
    assert got == {1: "a", 2: "c", None: None} and t.read().count() == 3
    t.apply(spark.createDataFrame([], SCHEMA), 2)
    assert t.versions() == [0, 1, 2] and t.read().count() == 3


def test_stream_restarts_and_repeats(spark, tmp_path):
    at = f"file://{tmp_path}"
    for part in range(3):
        spark.createDataFrame([(k, part, f"p{part}") for k in range(part * 3, 12)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        flows.upsert_into(flows.source(spark, f"{at}/in", SCHEMA, 1), f"{at}/t", "k", "n", f"{at}/c", buckets=5).awaitTermination()
    assert {r.k: r.n for r in flows.current(spark, f"{at}/t").collect()} == {k: min(2, k // 3) for k in range(12)}


def test_upsert_and_merge_with_null_and_repeated_keys(spark):
    stored = spark.createDataFrame([(None, 0, "old"), (1, 0, "one"), (2, 0, "two")], SCHEMA)
    changes = spark.createDataFrame([(None, 1, "b"), (None, 1, "a"), (2, 1, "x"), (2, 1, "y")], SCHEMA)
    assert rows(incremental.upsert(stored, changes, "k")) == [(1, 0, "one"), (2, 1, "y"), (None, 1, "b")]
    half = spark.createDataFrame([(None, None, "w"), (None, 7, None), (3, 1, None)], SCHEMA)
    merged = incremental.merge(stored, half, "k")
    assert rows(merged) == [(1, 0, "one"), (2, 0, "two"), (3, 1, None), (None, 7, "w")]
    assert rows(incremental.merge(merged, half, "k")) == rows(merged)


def test_waiting_reloads_are_answered_together():
    go, seen = threading.Event(), []

    def rebuild():
        go.wait(10)
        seen.append(time.monotonic())
        return len(seen)

    r = Reloads(rebuild)
    first = r.request()
    time.sleep(0.1)
    others = [r.request() for _ in range(20)]
    go.set()
    assert first.result(10) == 1 and {f.result(10) for f in others} == {2} and r.rebuilt == 2

    def broken():
        raise ValueError("no")

    assert isinstance(Reloads(broken).request().exception(10), ValueError)


def test_one_stream_to_several_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    sinks = {"even": lambda d: d.filter("k % 2 = 0"), "sums": lambda d: d.groupBy("v").agg(F.sum("n").alias("n"))}
    for part in range(3):
        spark.createDataFrame([(k, part, f"p{k % 2}") for k in range(6)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        flows.fan_out(flows.source(spark, f"{at}/in", SCHEMA, 1), sinks, f"{at}/out", f"{at}/c").awaitTermination()
    assert spark.read.parquet(f"{at}/out/even").count() == 9
    assert rows(spark.read.parquet(f"{at}/out/sums").groupBy("v").agg(F.sum("n"))) == [("p0", 9), ("p1", 9)]


def test_a_bounded_set_of_seen_keys(spark, tmp_path):
    at, schema = f"file://{tmp_path}", "feed string, k long, at long"
    batches = [[("a", 1, 1), ("a", 2, 2), ("a", 1, 3), ("b", 1, 1)], [("a", 2, 4), ("a", 3, 5), ("a", 4, 6), ("a", 1, 7)], [("a", 4, 8), ("b", 1, 9)]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        flows.append(flows.newly_seen(flows.source(spark, f"{at}/in", schema, 1), "feed", "k", "at", most=3), f"{at}/out", f"{at}/c").awaitTermination()
    # 1 is new again in the second batch: 2, 3 and 4 are the last three by then
    assert rows(spark.read.parquet(f"{at}/out")) == [("a", 1, 1), ("a", 1, 7), ("a", 2, 2), ("a", 3, 5), ("a", 4, 6), ("b", 1, 1)]


def test_a_scope_leaves_only_what_the_caller_wrote(spark, tmp_path, sf_dir):
    from tessera.operators import stats
    from tessera.storage import scope, shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scope(spark):
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        with scope(spark):
            stats.rolling_mean(v.select("vec_id", F.col("vec_id").cast("double").alias("x")), "x", "vec_id", 5).write.parquet(f"file://{tmp_path}/out")
        assert set(os.listdir(folder)) == before
        stats.dimension_bounds(v).collect()
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and spark.read.parquet(f"file://{tmp_path}/out").count() == 496
