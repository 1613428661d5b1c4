"""The pipeline's stages against their own operators and brute force, and the registered SQL."""

import math
import os
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from test_jaccard import kept
from test_llm import DOCS, ODD

from tessera.llm import language_id, line_dedup, mixing, queries


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)


def test_stages_hand_on_documents(spark, sf_dir, docs, tmp_path):
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = os.path.join(tmp_path, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        before, docs = docs, spark.read.parquet(at)
        seen.append((before, docs))
        assert docs.count() > 0
        if name != "sequences":
            assert docs.columns == before.columns
    (raw, told), (_, lined), (_, alone), (_, mixed), (_, packed) = seen
    # language: only documents without a clear language go
    report = {r.doc_id: r for r in language_id.language_report(raw).collect()}
    want = {k for k, r in report.items() if r.lang_pred != "und" and not r.ambiguous}
    assert {r.doc_id for r in told.collect()} == want
    # lines: the texts that the report describes
    hashes = {r.doc_id: r.kept_sha256 for r in line_dedup.line_report(told).collect()}
    assert {r.doc_id: r.h for r in lined.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == hashes
    # near copies: the smallest id of each component of texts with a Jaccard similarity of 0.8 or more
    assert {r.doc_id for r in alone.collect()} == kept({r.doc_id: r.text for r in lined.collect()})[0]
    # mix: every document as often as it is taken
    taken = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in mixing.mix_report(alone).collect()}
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({k: n for k, n in taken.items() if n})
    # sequences: nothing is lost and none is overfull
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 2048 and {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("id", "key", "doc", "version", "taken", "lang_pred", "fp", "component", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf_dir)
    nothing = stage(spark, odd.limit(0), sf_dir)
    assert nothing.count() == 0 and nothing.columns == out.columns
    ids = Counter(r.doc_id for r in out.collect())
    all_ids = Counter(r[0] for r in ODD)
    if name != "sequences":
        assert out.columns == odd.columns
    if name == "language":  # without words or letters
        assert not {1, 2, 3, 9} & set(ids) and ids[None] <= 1
    if name == "lines":
        assert ids == all_ids and {r.doc_id for r in out.collect() if r.text is None} == {1, None}
    if name == "near_copies":  # one without words, the smaller of 4 and 5, and all others
        assert ids == Counter({None: 2, 4: 1, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    if name == "mix":
        assert not {1, 2, 3} & set(ids)
    if name == "sequences":
        assert set(ids) == set(all_ids)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    for name, rows_ in (("odd", ODD), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows_, DOCS).write.parquet(f"{at}/documents.parquet")
        assert (corpus_pipeline.run(spark, at).count() > 0) == (name == "odd")
