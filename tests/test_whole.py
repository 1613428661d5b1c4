"""Queries do the whole job, not a part of it."""

import numpy as np
import pytest

from tessera.operators import dedup, quantize
from tessera.plans import registry

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def asked(spark, sf_dir):
    return {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}


@pytest.mark.parametrize("name", ["exact_knn_batch", "greedy_near_dup", "beam_search", "near_dup_pairs", "opq_search"])
def test_every_fiftieth_vector_is_asked(spark, sf_dir, asked, name):
    assert {r.query_id for r in QUERIES[name](spark, sf_dir).collect()} == asked


@pytest.mark.parametrize("name", ["recall_at_k", "coded_beam_search"])
def test_recall_over_every_fiftieth_vector(spark, sf_dir, asked, name):
    got = QUERIES[name](spark, sf_dir).first()
    assert got.queries == len(asked) and got.at_least_90


@pytest.mark.parametrize("threshold, block", [(0.3, 4_096), (0.45, 200)])
def test_near_copies_cross_labels(spark, sf_dir, threshold, block):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted(df.select("vec_id", "embedding").collect())
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    near = x @ x.T > threshold
    np.fill_diagonal(near, False)
    least = np.arange(len(ids))
    for _ in ids:
        least = np.minimum(least, np.where(near, least[None], len(ids)).min(1))
    want = {(k, ids[c], int(n)) for k, c, n in zip(ids, least, near.sum(1), strict=True)}
    assert {tuple(r) for r in dedup.near_classes(df, threshold, block=block).collect()} == want


def test_near_dup_classes_are_of_the_whole_table(spark, sf_dir):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], np.float64)
    near = x @ x.T > 0.3
    assert sum(r.links for r in QUERIES["near_dup_classes"](spark, sf_dir).collect()) == near.sum() - len(x)


def test_recall_of_coded_search(spark, sf_dir):
    truth = {(r.query_id, r.vec_id) for r in QUERIES["exact_knn_batch"](spark, sf_dir).collect()}
    found = {(r.query_id, r.vec_id) for r in QUERIES["opq_search"](spark, sf_dir).collect()}
    assert len(truth & found) >= 0.9 * len(truth)


def test_every_document_is_a_partner(spark, sf_dir):
    sizes = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").collect()}
    links = {k: sum(m == n for m in sizes.values()) for k, n in sizes.items()}
    assert {r.doc_id: r.links for r in QUERIES["tolerance_join"](spark, sf_dir).collect()} == links


def test_covariance_of_all_dimensions(spark, sf_dir):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()], np.float64)
    want = np.cov(x.T, bias=True)
    got = {(r.i, r.j): r["cov"] for r in QUERIES["covariance"](spark, sf_dir).collect()}
    assert set(got) == {(i, j) for i in range(len(want)) for j in range(i, len(want))}
    assert all(abs(c - want[k]) < 1e-8 for k, c in got.items())


def test_all_vectors_are_judged_though_a_sample_is_fitted(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    few = quantize.sample_matrix(df, 100)
    monkeypatch.setattr(quantize, "sample_matrix", lambda *a, **k: few)
    assert len(few) < df.count()
    for name in ("chain_quantizer", "one_bit_quantizer"):
        assert QUERIES[name](spark, sf_dir).first().n == df.count()
    x = np.array([r.embedding for r in df.collect()], np.float64)
    models = quantize.codecs(few, 8, 16)
    got = {r.codec: r.error for r in QUERIES["compared_codecs"](spark, sf_dir).collect()}
    assert got == {k: pytest.approx(((x - m.decode(m.encode(x))) ** 2).sum(1).mean(), abs=2e-6) for k, m in models.items()}
