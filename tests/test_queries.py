"""Every query against its SQL, and the shape of those without."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_agrees_with_itself(spark, sf_dir, name):
    a, b = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert a and a == b


def test_recall_of_graph_search(spark, sf_dir):
    assert QUERIES["recall_at_k"](spark, sf_dir).first()["at_least_90"]


def test_models_do_what_they_claim(spark, sf_dir):
    first = lambda name: QUERIES[name](spark, sf_dir).first()
    chain, one_bit = first("chain_quantizer"), first("one_bit_quantizer")
    assert chain.four < 0.8 * chain.one and one_bit.recall >= 0.9 and one_bit.correlation > 0.7
    assert all(r.accuracy > 0.7 for r in QUERIES["preference_model"](spark, sf_dir).collect())
    routed = {r.probes: r.recall for r in QUERIES["routed_search"](spark, sf_dir).collect()}
    assert routed[8] >= 0.9 and list(routed.values()) == sorted(routed.values())
    gaps = {r.method: r.deviation for r in QUERIES["annealed_shards"](spark, sf_dir).collect()}
    assert gaps["annealed"] < gaps["k-means"]


def test_search_on_the_packed_table(spark, sf_dir):
    r = QUERIES["packed_search"](spark, sf_dir).first()
    assert r.queries == 10 and r.recall >= 0.9 and r.most_reads < r.nodes


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
