"""Queries over vectors: search, descriptors, shards, quantizers and duplicates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, fp16_decode, fp16_encode, mean_vectors, query_vector, sign_code
from ..operators import blocks, dedup, quantize, search, shards, stats
from ..operators.order import positions
from ..sources.files import table
from ..storage import fresh_path, materialize
from .base import query

VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
CENTROIDS = f"""
centroids AS (
  SELECT label, list(x ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})) GROUP BY label, pos
  ) GROUP BY label
)"""
TERMS = [(0, 1.0), (1, 0.5), (2, -0.5)]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _query(spark, sf_dir, terms=TERMS):
    return search.weighted_query(spark.createDataFrame(terms, "vec_id long, weight double"), _vectors(spark, sf_dir))


def _sql_query(terms=TERMS) -> str:
    values = ", ".join(f"({i}, {w}::DOUBLE)" for i, w in terms)
    return f"""q AS (
  SELECT list(x ORDER BY pos) AS qv FROM (
    SELECT pos, sum(w * x) AS x FROM (
      SELECT t.w, unnest(v.e) AS x, unnest(range(len(v.e))) AS pos FROM ({VEC}) v JOIN (VALUES {values}) t(vec_id, w) ON v.vec_id = t.vec_id
    ) GROUP BY pos)
)"""


def asked(vectors):
    """The query set: every fiftieth vector."""
    return vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


def _centroids(spark, sf_dir):
    return mean_vectors(_vectors(spark, sf_dir), "label").select(F.col("label").alias("shard_id"), "centroid")


@query(f"""
    WITH {_sql_query()}
    SELECT vec_id, round(list_dot_product(e, qv), 9) AS score FROM ({VEC}), q ORDER BY list_dot_product(e, qv) DESC, vec_id LIMIT 10""")
def weighted_topk(spark, sf_dir):
    best = search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10)
    return best.select("vec_id", F.round("score", 9).alias("score"))


SIGNED = [(3, 1.0), (4, -2.0), (5, 0.25)]


@query(f"""
    WITH {_sql_query(SIGNED)}
    SELECT vec_id, round(list_dot_product(e, qv), 9) AS score FROM ({VEC}), q ORDER BY list_dot_product(e, qv) DESC, vec_id LIMIT 20""")
def signed_query(spark, sf_dir):
    terms = spark.createDataFrame([(3, 1.0, "+"), (4, 2.0, "-"), (5, 0.25, "+")], "vec_id long, w double, sign string")
    terms = terms.select("vec_id", search.signed(F.col("w"), F.col("sign")).alias("weight"))
    best = search.top_k(_vectors(spark, sf_dir), search.weighted_query(terms, _vectors(spark, sf_dir)), 20)
    return best.select("vec_id", F.round("score", 9).alias("score"))


@query(f"""
    WITH {CENTROIDS}, q AS (
      SELECT list(x ORDER BY pos) AS qv FROM (
        SELECT pos, sum(w * x) AS x FROM (
          SELECT t.w, unnest(c) AS x, unnest(range(len(c))) AS pos FROM centroids JOIN (VALUES (1, 1.0::DOUBLE), (2, -0.5::DOUBLE)) t(label, w) ON centroids.label = t.label
        ) GROUP BY pos)
    )
    SELECT vec_id, round(list_dot_product(e, qv), 9) AS score FROM ({VEC}), q ORDER BY list_dot_product(e, qv) DESC, vec_id LIMIT 15""")
def predefined_terms(spark, sf_dir):
    """Terms by predefined name; a name that isn't there is ignored."""
    named = _centroids(spark, sf_dir).select(F.concat(F.lit("label "), "shard_id").alias("name"), F.col("centroid").alias("embedding"))
    terms = spark.createDataFrame(
        [(None, None, None, "label 1", None), (None, None, None, "label 2", -0.5), (None, None, None, "none such", 3.0)],
        "embedding array<float>, image string, text string, predefined_embedding string, weight double",
    )
    best = search.top_k(_vectors(spark, sf_dir), search.total_query(terms, named), 15)
    return best.select("vec_id", F.round("score", 9).alias("score"))


@query(f"""
    WITH s AS (
      SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM ({VEC}) a, ({VEC}) b WHERE a.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, rank, round(score, 9) AS score FROM r WHERE rank <= 10""")
def exact_knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return search.batch_top_k(v, asked(v), 10).withColumn("score", F.round("score", 9))


@query(f"""
    WITH {_sql_query()}, s AS (SELECT vec_id, label AS container, list_dot_product(e, qv) AS score FROM ({VEC}), q)
    SELECT container, vec_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY container ORDER BY score DESC, vec_id) AS n FROM s) WHERE n = 1""")
def best_per_container(spark, sf_dir):
    v = _vectors(spark, sf_dir).crossJoin(F.broadcast(_query(spark, sf_dir))).select("vec_id", F.col("label").alias("container"), dot("embedding", "query").alias("score"))
    return search.best_per_container(v).select("container", "vec_id", F.round("score", 9).alias("score"))


@query(f"""
    WITH {_sql_query()}, best AS (
      SELECT vec_id, label, list_dot_product(e, qv) AS score FROM ({VEC}), q ORDER BY score DESC, vec_id LIMIT 50
    ) SELECT vec_id, round(score, 9) AS score FROM best WHERE label < 5""")
def filter_after_topk(spark, sf_dir):
    """The policy applies after the top k, so fewer rows may come back."""
    best = search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 50)
    return best.filter("label < 5").select("vec_id", F.round("score", 9).alias("score"))


@query(f"""
    WITH {_sql_query()}
    SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(e, qv) DESC, vec_id) - 41 AS place FROM ({VEC}), q
    QUALIFY row_number() OVER (ORDER BY list_dot_product(e, qv) DESC, vec_id) BETWEEN 41 AND 80""")
def result_page(spark, sf_dir):
    """The second page of 40 results."""
    best = search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 80)
    return positions(best, [F.col("score").desc(), F.col("vec_id")]).select("vec_id", (F.col("place") - 40).alias("place")).filter("place >= 0")


@query(f"""
    WITH {_sql_query()}, steps AS (SELECT unnest(range(-2, 3)) AS step),
    d AS (SELECT e AS dv FROM ({VEC}) WHERE vec_id = 9),
    s AS (SELECT step, vec_id, list_dot_product(e, qv) + step / 2.0 * list_dot_product(e, dv) AS score FROM ({VEC}), q, d, steps),
    r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT CAST(step AS INTEGER) AS step, vec_id FROM r WHERE n = 1""")
def query_refinement(spark, sf_dir):
    direction = _vectors(spark, sf_dir).filter("vec_id = 9").first()["embedding"]
    moved = search.refinements(_query(spark, sf_dir), direction).select(F.col("step").cast("long").alias("query_id"), F.col("query").alias("embedding"))
    return search.batch_top_k(_vectors(spark, sf_dir), moved, 1).select(F.col("query_id").cast("int").alias("step"), "vec_id")


@query(f"""
    WITH {CENTROIDS} SELECT CAST(label AS BIGINT) AS label, pos, round(x, 9) AS x
    FROM (SELECT label, unnest(c) AS x, unnest(range(len(c))) AS pos FROM centroids)""")
def label_centroids(spark, sf_dir):
    c = _centroids(spark, sf_dir).select(F.col("shard_id").cast("long").alias("label"), F.posexplode("centroid").alias("pos", "x"))
    return c.select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT v.label, vec_id, list_dot_product(e, c) AS score FROM ({VEC}) v JOIN centroids c ON v.label = c.label)
    SELECT label, vec_id AS medoid, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id DESC) AS n FROM s) WHERE n = 1""")
def medoids(spark, sf_dir):
    return shards.medoids(_vectors(spark, sf_dir), "label").withColumn("score", F.round("score", 9))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT vec_id, c.label AS shard_id, list_dot_product(e, c) AS score FROM ({VEC}) v, centroids c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shard_id) AS choice FROM s)
    SELECT vec_id, shard_id, choice, round(score, 9) AS score FROM r WHERE choice <= 2""")
def shard_top2(spark, sf_dir):
    return shards.nearest_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT vec_id, c.label AS shard_id, list_dot_product(e, c) AS score FROM ({VEC}) v, centroids c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shard_id) AS choice FROM s)
    SELECT shard_id, choice, count(*) AS n FROM r WHERE choice <= 2 GROUP BY shard_id, choice""")
def shard_sizes(spark, sf_dir):
    return shards.shard_sizes(shards.nearest_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir)))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT vec_id, c.label AS shard_id, list_dot_product(e, c) AS score FROM ({VEC}) v, centroids c),
    r AS (SELECT shard_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shard_id) AS choice FROM s) WHERE choice <= 2 GROUP BY shard_id),
    d AS (SELECT shard_id, abs(n - (SELECT avg(n) FROM r)) AS deviation FROM r)
    SELECT shard_id, round(deviation, 9) AS deviation FROM d ORDER BY deviation DESC, shard_id DESC LIMIT 1""")
def shard_imbalance(spark, sf_dir):
    m = shards.imbalance(shards.nearest_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir)))
    return m.withColumn("deviation", F.round("deviation", 9))


@query(f"""
    WITH {CENTROIDS}, {_sql_query()}
    SELECT label AS shard_id, round(list_dot_product(c, qv), 9) AS score FROM centroids, q ORDER BY list_dot_product(c, qv) DESC, label DESC LIMIT 1""")
def route_shard(spark, sf_dir):
    return search.route(_query(spark, sf_dir), _centroids(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT vec_id, c.label AS shard_id, list_dot_product(e, c) AS score FROM ({VEC}) v, centroids c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shard_id) AS choice FROM s)
    SELECT vec_id, shard_id, choice, round(score, 9) AS score FROM r WHERE choice <= 2""")
def balanced_shards_even(spark, sf_dir):
    """Without a penalty on full shards the balanced way gives the two nearest."""
    b = shards.balanced_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir), fudge=0.0)
    return b.select("vec_id", F.col("shard_id").cast("int").alias("shard_id"), "choice", F.round("score", 9).alias("score"))


def balanced_fold(lane: str, order: str) -> str:
    """SQL: the law of balance as a recursive fold over the records of each lane."""
    return f"""
    WITH RECURSIVE {CENTROIDS}, d AS (
      SELECT vec_id, {lane} AS lane, list(list_dot_product(e, c) ORDER BY c.label) AS dots, list(c.label ORDER BY c.label) AS labels FROM ({VEC}) v, centroids c GROUP BY vec_id
    ), v AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY {order}) AS i FROM d
    ), fold(lane, i, vec_id, a, b, s, labels, counts) AS (
      SELECT DISTINCT lane, 0::BIGINT, NULL::BIGINT, 0, 0, []::DOUBLE[], labels, list_transform(dots, lambda x: 0::BIGINT) FROM v
      UNION ALL
      SELECT lane, i, vec_id, a, b, s, labels, list_transform(counts, lambda x, j: x + CASE WHEN j = a OR j = b THEN 1 ELSE 0 END)
      FROM (SELECT *, list_position(s, list_max(list_transform(s, lambda x, j: CASE WHEN j = a THEN -1e9 ELSE x END))) AS b
            FROM (SELECT *, list_position(s, list_max(s)) AS a
                  FROM (SELECT v.lane, v.i, v.vec_id, v.labels, f.counts, list_transform(v.dots, lambda x, j: x - 0.2::DOUBLE * (f.counts[j]::DOUBLE / v.i::DOUBLE)) AS s
                        FROM fold f JOIN v ON v.lane = f.lane AND v.i = f.i + 1)))
    )
    SELECT vec_id, labels[a] AS shard_id, CAST(1 AS BIGINT) AS choice, round(s[a], 9) AS score FROM fold WHERE i > 0
    UNION ALL SELECT vec_id, labels[b], 2, round(s[b], 9) FROM fold WHERE i > 0"""


@query(balanced_fold("vec_id % CAST(ceil((SELECT count(*) FROM embeddings) / 250.0) AS BIGINT)", "vec_id"))
def balanced_shards(spark, sf_dir):
    """The two shards of each vector as they fill up, in lanes of about 250 vectors."""
    b = shards.balanced_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir), lane_rows=250)
    return b.select("vec_id", F.col("shard_id").cast("int").alias("shard_id"), "choice", F.round("score", 9).alias("score"))


@query(f"""
    WITH {CENTROIDS}, s AS (SELECT vec_id, c.label AS shard_id, list_dot_product(e, c) AS score FROM ({VEC}) v, centroids c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shard_id) AS choice FROM s)
    SELECT vec_id, shard_id, choice FROM r WHERE choice <= 2 AND shard_id < 3""")
def first_shards(spark, sf_dir):
    """What belongs to the first three shards, written in a folder for each and read back."""
    at = fresh_path(spark, "shards")
    shards.write_shards(shards.first_shards(shards.nearest_shards(_vectors(spark, sf_dir), _centroids(spark, sf_dir)), 3), at, rows=100)
    return spark.read.parquet(at).select("vec_id", "shard_id", "choice")


@query()
def spherical_kmeans(spark, sf_dir):
    c = shards.spherical_kmeans(_vectors(spark, sf_dir), 8, balance=0.05)
    return shards.nearest_shards(_vectors(spark, sf_dir), c, 1).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def routed_search(spark, sf_dir):
    """Every fiftieth vector asks for its ten nearest in the shards it is routed to: recall by the number of shards probed; shards follow the rows."""
    v = _vectors(spark, sf_dir)
    n = max(4, v.count() // 50)
    centroids = shards.spherical_kmeans(v, min(n, 1024), balance=0.05)
    assigned = shards.nearest_shards(v, centroids).select("vec_id", "shard_id").join(v.select("vec_id", "embedding"), "vec_id")
    probes = [1, 2, 4, 8, 16]
    found = materialize(search.routed_candidates(assigned, asked(v), centroids, 10, probes[-1]))
    truth = materialize(search.batch_top_k(v, asked(v), 10))
    best = lambda p: blocks.ranked(found.filter(F.col("choice") <= p).select(F.col("query_id").alias("q"), F.col("vec_id").alias("v"), "score"), 10, "query_id", "vec_id")
    rows = [stats.recall(truth, best(p), 10).select(F.lit(p).alias("probes"), F.lit(min(n, 1024)).cast("long").alias("shards"), "queries", F.round("recall", 6).alias("recall")) for p in probes]
    return reduce(DataFrame.unionByName, rows)


@query()
def annealed_shards(spark, sf_dir):
    """How far the fullest or emptiest shard is from the even size, over first and second choices: k-means, and annealed from there."""
    v = _vectors(spark, sf_dir)
    start = shards.spherical_kmeans(v, 8, balance=0.05)
    _, m = shards.checked_centroids(start)
    counts = shards.spill_counts(v, m[None])[0]
    found, least = shards.annealed_centroids(v, start)
    sizes = shards.nearest_shards(v, found).groupBy("choice", "shard_id").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.sum(1)[0] / len(m)
    annealed = sizes.agg(F.max(F.abs(F.col("n") - F.lit(float(mean)))).alias("deviation")).select(F.lit("annealed").alias("method"), F.round("deviation", 6).alias("deviation"))
    plain = float(np.abs(counts - counts.sum(1, keepdims=True) / len(m)).max())
    return annealed.unionByName(spark.createDataFrame([("k-means", round(plain, 6))], "method string, deviation double"))


@query(f"""
    WITH refs AS (SELECT vec_id AS ref, e AS r FROM ({VEC}) WHERE vec_id < 3),
    s AS (SELECT ref, list_dot_product(e, r) AS score FROM ({VEC}), refs)
    SELECT ref, CAST(greatest(0, least(511, floor((score - -1.0::DOUBLE) / 2.0::DOUBLE * 512))) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ref, bin""")
def ref_histogram(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    refs = v.filter("vec_id < 3").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("r"))
    return stats.histogram(v.crossJoin(F.broadcast(refs)), dot("embedding", "r"), "ref")


@query(f"""
    WITH refs AS (SELECT vec_id AS ref, e AS r FROM ({VEC}) WHERE vec_id < 3)
    SELECT vec_id FROM ({VEC}) WHERE NOT EXISTS (SELECT 1 FROM refs WHERE list_dot_product(e, r) >= 0.25)""")
def embedding_prefilter(spark, sf_dir):
    """Vectors near any reference go; the few references are a parameter, in one row beside each vector."""
    v = _vectors(spark, sf_dir)
    return v.crossJoin(F.broadcast(_references(v))).filter(~F.exists("refs", lambda r: dot("embedding", r) >= 0.25)).select("vec_id")


def _references(v):
    """One row ``refs`` with the three reference vectors."""
    return v.filter("vec_id < 3").agg(F.collect_list("embedding").alias("refs"))


@query(f"""
    WITH refs AS (SELECT e AS r FROM ({VEC}) WHERE vec_id < 3),
    m AS (SELECT vec_id, max(list_dot_product(e, r)) AS near FROM ({VEC}), refs GROUP BY vec_id)
    SELECT vec_id, near >= 0.2 AS dead, CASE WHEN near >= 0.2 THEN '' ELSE 'v/' || vec_id END AS url FROM m""")
def postfilter_dead(spark, sf_dir):
    """Vectors near a reference stay in the graph with a blank URL."""
    v = _vectors(spark, sf_dir)
    marked = v.crossJoin(F.broadcast(_references(v))).select("vec_id", F.exists("refs", lambda r: dot("embedding", r) >= 0.2).alias("dead"))
    return marked.withColumn("url", F.when(F.col("dead"), "").otherwise(F.concat(F.lit("v/"), "vec_id")))


COPIES = f"SELECT vec_id, e, 'u' || (vec_id % 450) AS url FROM ({VEC}) UNION ALL SELECT vec_id + 100000, list_transform(e, lambda x: x * 2), 'c' || vec_id FROM ({VEC}) WHERE vec_id % 10 = 0"


@query(f"""
    WITH c AS ({COPIES}), k AS (SELECT *, list_aggregate(list_transform(e, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code FROM c),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY vec_id) AS n FROM k) WHERE n = 1),
    b AS (SELECT * FROM (SELECT vec_id, url, code, row_number() OVER (PARTITION BY url ORDER BY vec_id) AS n FROM a) WHERE n = 1)
    SELECT vec_id, url, md5(code) AS code_md5 FROM b""")
def sign_code_dedup(spark, sf_dir):
    """Scaled copies share a sign code, and some URLs repeat."""
    v = _vectors(spark, sf_dir)
    copies = v.filter("vec_id % 10 = 0").select((F.col("vec_id") + 100000).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"), F.concat(F.lit("c"), "vec_id").alias("url"))
    all_rows = v.select("vec_id", "embedding", F.concat(F.lit("u"), F.col("vec_id") % 450).alias("url")).unionByName(copies)
    return dedup.ingest_dedup(all_rows).select("vec_id", "url", F.md5(sign_code("embedding")).alias("code_md5"))


ASKED = f"""
found AS (
  SELECT * FROM (
    SELECT a.vec_id AS query_id, b.vec_id, b.e, list_dot_product(a.e, b.e) AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS rank FROM ({VEC}) a, ({VEC}) b WHERE a.vec_id % 50 = 0
  ) WHERE rank <= 100
)"""


@query(f"""
    WITH {ASKED}
    SELECT a.query_id, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 9) AS score
    FROM found a JOIN found b ON a.query_id = b.query_id AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) > 0.3""")
def near_dup_pairs(spark, sf_dir):
    """Near copies within each query's results, of which there are a hundred at most."""
    v = _vectors(spark, sf_dir)
    found = search.batch_top_k(v, asked(v), 100).select("query_id", "vec_id").join(v, "vec_id")
    return dedup.near_pairs(found, 0.3, groups=["query_id"]).withColumn("score", F.round("score", 9))


@query(f"""
    WITH RECURSIVE links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ({VEC}) a, ({VEC}) b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) > 0.3),
    reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT reach.a AS vec_id, min(reach.b) AS class, coalesce(any_value(n.n), 0) AS links FROM reach LEFT JOIN n ON reach.a = n.a GROUP BY reach.a""")
def near_dup_classes(spark, sf_dir):
    """Classes of near copies among all vectors, whatever their labels."""
    return dedup.near_classes(_vectors(spark, sf_dir), 0.3)


@query(f"""
    WITH RECURSIVE {ASKED}, kept(query_id, rank, vec_id, score, taken, es) AS (
      SELECT query_id, rank, vec_id, score, true, [e] FROM found WHERE rank = 1
      UNION ALL
      SELECT f.query_id, f.rank, f.vec_id, f.score, len(list_filter(k.es, lambda o: list_dot_product(o, f.e) > 0.3)) = 0,
             CASE WHEN len(list_filter(k.es, lambda o: list_dot_product(o, f.e) > 0.3)) = 0 THEN list_append(k.es, f.e) ELSE k.es END
      FROM kept k JOIN found f ON f.query_id = k.query_id AND f.rank = k.rank + 1
    ) SELECT query_id, vec_id, round(score, 9) AS score FROM kept WHERE taken""")
def greedy_near_dup(spark, sf_dir):
    """Results of every fiftieth vector's query without rows near a better one."""
    v = _vectors(spark, sf_dir)
    found = search.batch_top_k(v, asked(v), 100)
    return dedup.greedy_near_dup(found.join(v, "vec_id"), 0.3).withColumn("score", F.round("score", 9))


@query(f"""
    WITH cand AS (SELECT * FROM ({VEC}) WHERE vec_id % 5 = 0), idx AS (SELECT * FROM ({VEC}) WHERE vec_id % 5 <> 0),
    n AS (SELECT cand.vec_id, max(list_dot_product(cand.e, idx.e)) AS nearest FROM cand, idx GROUP BY cand.vec_id)
    SELECT vec_id, round(nearest, 9) AS nearest FROM n WHERE nearest <= 0.35""")
def novel_items(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    out = search.novel(v.filter("vec_id % 5 = 0"), v.filter("vec_id % 5 != 0"), 0.35)
    return out.select("vec_id", F.round("nearest", 9).alias("nearest"))


# Codewords: the parts of the 16 vectors with the lowest ids, in 8 subspaces of equal width, without a rotation.
SUB = 8
PQ = f"""
words AS (
  SELECT vec_id AS code, s, e[s * len(e) // {SUB} + 1 : (s + 1) * len(e) // {SUB}] AS w FROM ({VEC}), (SELECT unnest(range({SUB})) AS s) WHERE vec_id < 16
), parts AS (
  SELECT vec_id, s, e[s * len(e) // {SUB} + 1 : (s + 1) * len(e) // {SUB}] AS p FROM ({VEC}), (SELECT unnest(range({SUB})) AS s)
), coded AS (
  SELECT vec_id, s, code, w, p FROM (
    SELECT vec_id, parts.s, code, w, p, row_number() OVER (PARTITION BY vec_id, parts.s ORDER BY list_dot_product(p, w) DESC, code) AS n FROM parts JOIN words ON parts.s = words.s
  ) WHERE n = 1
)"""


def _quantizer(spark, sf_dir):
    rows = _vectors(spark, sf_dir).filter("vec_id < 16").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    return quantize.ProductQuantizer(x.reshape(len(x), SUB, -1).transpose(1, 0, 2))


@query(f"WITH {PQ} SELECT vec_id, list_aggregate(list(code ORDER BY s), 'string_agg', ',') AS codes FROM coded GROUP BY vec_id")
def pq_encode(spark, sf_dir):
    coded = quantize.pq_encode(_vectors(spark, sf_dir), _quantizer(spark, sf_dir))
    return coded.select("vec_id", F.array_join("codes", ",").alias("codes"))


@query(f"""
    WITH {PQ}, {_sql_query()}, lut AS (SELECT s, code, list_dot_product(w, qv[s * len(qv) // {SUB} + 1 : (s + 1) * len(qv) // {SUB}]) AS d FROM words, q)
    SELECT coded.vec_id, round(sum(d), 9) AS score FROM coded JOIN lut ON coded.s = lut.s AND coded.code = lut.code
    GROUP BY coded.vec_id ORDER BY round(sum(d), 9) DESC, coded.vec_id LIMIT 20""")
def pq_adc_topk(spark, sf_dir):
    model = _quantizer(spark, sf_dir)
    q = np.array(_query(spark, sf_dir).first()["query"])
    coded = quantize.pq_encode(_vectors(spark, sf_dir), model)
    scored = coded.withColumn("score", F.round(quantize.adc_score("codes", model.table(q)), 9))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(20).select("vec_id", "score")


@query(f"WITH {PQ}, {_sql_query()} SELECT s, code, round(list_dot_product(w, qv[s * len(qv) // {SUB} + 1 : (s + 1) * len(qv) // {SUB}]), 9) AS d FROM words, q")
def pq_lut(spark, sf_dir):
    """The query's table as a join of its parts with the codewords."""
    rows = _vectors(spark, sf_dir).filter("vec_id < 16").withColumnRenamed("vec_id", "code")
    words = quantize.codeword_table(rows, SUB)
    parts = quantize.codeword_table(_query(spark, sf_dir).select(F.lit(0).alias("code"), F.col("query").alias("embedding")), SUB)
    parts = parts.select("subspace", F.col("codeword").alias("part"))
    return words.join(parts, "subspace").select(F.col("subspace").cast("long").alias("s"), "code", F.round(dot("codeword", "part"), 9).alias("d"))


@query(f"WITH {PQ} SELECT round(sum(list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - w[i]) * (p[i] - w[i])))) / count(DISTINCT vec_id), 9) AS error FROM coded")
def pq_error(spark, sf_dir):
    model = _quantizer(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    return quantize.reconstruction_error(quantize.pq_encode(v, model), model, v).withColumn("error", F.round("error", 9))


@query()
def opq_search(spark, sf_dir):
    """Every fiftieth vector's neighbours by a learned rotation and codebooks; the best by codes are ordered anew by exact scores."""
    v = _vectors(spark, sf_dir)
    model = quantize.train_pq(quantize.sample_matrix(v), 16, 64, rounds=8)
    return quantize.adc_batch_top_k(v, asked(v), model, 10).withColumn("score", F.round("score", 9))


@query(f"""
    WITH d AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})),
    b AS (SELECT pos, quantile_cont(x, 0.0005) AS lo, quantile_cont(x, 0.9995) AS hi FROM d GROUP BY pos)
    SELECT pos, round(lo, 9) AS low, round(hi, 9) AS high FROM b""")
def dimension_bounds(spark, sf_dir):
    b = stats.dimension_bounds(_vectors(spark, sf_dir))
    return b.select(F.col("pos").cast("long").alias("pos"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""
    WITH d AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})),
    b AS (SELECT pos, round(quantile_cont(x, 0.0005), 6) AS lo, round(quantile_cont(x, 0.9995), 6) AS hi FROM d GROUP BY pos),
    c AS (SELECT vec_id, d.pos, CAST(least(255, greatest(0, round((x - lo) * (255 / (hi - lo))))) AS BIGINT) AS code FROM d JOIN b ON d.pos = b.pos)
    SELECT vec_id, list_aggregate(list(code ORDER BY pos), 'string_agg', ',') AS codes, CAST(sum(code * code) AS BIGINT) AS self_dot FROM c GROUP BY vec_id""")
def scalar_quantize(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    b = stats.dimension_bounds(v)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.round(c, 6).alias("q")))), lambda p: p["q"])
    bounds = b.agg(ordered("low").alias("low"), ordered("high").alias("high"))
    # one row of bounds, two numbers a dimension
    coded = v.crossJoin(F.broadcast(bounds)).select("vec_id", quantize.scalar_codes(F.transform("embedding", lambda x: x.cast("double")), F.col("low"), F.col("high")).alias("c"))
    return coded.select("vec_id", F.array_join("c", ",").alias("codes"), quantize.integer_dot("c", "c").alias("self_dot"))


@query(f"""
    WITH m AS (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})) GROUP BY pos))
    SELECT vec_id, list_aggregate(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN e[i] - m[i] > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM ({VEC}), m""")
def one_bit_codes(spark, sf_dir):
    """Signs about the mean, without a rotation."""
    from ..functions.vectors import added, by_dimension, gathered, scaled

    v = _vectors(spark, sf_dir)
    mean = gathered(by_dimension(v).groupBy("pos").agg(F.avg("x").alias("x")), to="mean")
    return v.crossJoin(F.broadcast(mean)).select("vec_id", sign_code(added("embedding", scaled("mean", F.lit(-1.0)))).alias("bits"))


@query(f"""
    WITH a AS (SELECT vec_id, e[1] AS s1, e[2] AS s2 FROM ({VEC})),
    z AS (SELECT quantile_cont(s1, list_transform(range(255), lambda k: k / 254.0::DOUBLE)) AS c1, quantile_cont(s2, list_transform(range(255), lambda k: k / 254.0::DOUBLE)) AS c2 FROM a)
    SELECT vec_id, len(list_filter(c1, lambda q: round(q, 9) < round(s1, 9))) AS d1, len(list_filter(c2, lambda q: round(q, 9) < round(s2, 9))) AS d2 FROM a, z""")
def descriptor_codes(spark, sf_dir):
    """Codes 0 to 255 of two channels against their 255 quantiles."""
    a = _vectors(spark, sf_dir).select("vec_id", F.col("embedding")[0].cast("double").alias("s1"), F.col("embedding")[1].cast("double").alias("s2"))
    # one row of quantiles
    z = stats.cdf(a, "s1").withColumnRenamed("cdf", "c1").crossJoin(stats.cdf(a, "s2").withColumnRenamed("cdf", "c2"))
    coded = a.crossJoin(F.broadcast(z))
    # both sides are rounded: a quantile that falls on a value is not below it
    code = lambda s, c: stats.descriptor_code(F.round(s, 9), F.transform(c, lambda q: F.round(q, 9))).cast("long")
    return coded.select("vec_id", code("s1", "c1").alias("d1"), code("s2", "c2").alias("d2"))


@query(f"""
    WITH {_sql_query()}, a AS (SELECT vec_id, list_dot_product(e, qv) + (2.0::DOUBLE / 512) * (vec_id % 256) + (-1.0::DOUBLE / 512) * (label * 20) AS score FROM ({VEC}), q)
    SELECT vec_id, round(score, 9) AS score FROM a ORDER BY score DESC, vec_id LIMIT 25""")
def descriptor_search(spark, sf_dir):
    """Two descriptor terms, of weight 2 and -1, bias the scores: weight / 512 per step of code."""
    v = _vectors(spark, sf_dir).withColumn("codes", F.array((F.col("vec_id") % 256).cast("int"), F.col("label") * 20))
    scales = F.array(F.lit(2.0 / 512), F.lit(-1.0 / 512))
    bias = F.aggregate(F.zip_with(scales, "codes", lambda s, c: s * c), F.lit(0.0), lambda a, x: a + x)
    best = search.top_k(v, _query(spark, sf_dir), 25, bias=bias)
    return best.select("vec_id", F.round("score", 9).alias("score"))


# Half precision keeps 11 bits from the leading one on, and no bit below 2 ** -24; ties go to even.
_STEP = "pow(2.0::DOUBLE, greatest(floor(log2(greatest(abs(x), 1e-30::DOUBLE))), -14) - 10)"
HALVES = f"halves AS (SELECT vec_id, pos, round_even(x / {_STEP}, 0) * {_STEP} AS x FROM (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})))"


@query(f"WITH {HALVES} SELECT vec_id, pos, x FROM halves")
def fp16_round_trip(spark, sf_dir):
    """Half precision and back."""
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode(fp16_decode(fp16_encode("embedding"))).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query(f"""
    WITH {HALVES}, q AS (SELECT list(x ORDER BY pos) AS qv FROM halves WHERE vec_id = 7)
    SELECT vec_id, round(list_dot_product(e, qv), 9) AS score FROM ({VEC}), q ORDER BY list_dot_product(e, qv) DESC, vec_id LIMIT 5""")
def base64_query(spark, sf_dir):
    """A query given as URL-safe base64 of half-precision values."""
    import base64

    blob = _vectors(spark, sf_dir).filter("vec_id = 7").select(fp16_encode("embedding").alias("b")).first()["b"]
    q = query_vector(base64.urlsafe_b64encode(bytes(blob)).decode().rstrip("="))
    one = spark.createDataFrame([([float(x) for x in q],)], "query array<double>")
    return search.top_k(_vectors(spark, sf_dir), one, 5).select("vec_id", F.round("score", 9).alias("score"))


@query("""
    SELECT round(sum(CASE WHEN label % 4 = 0 THEN vec_id / 100.0::DOUBLE ELSE 0 END) / 512, 9) AS quality,
           round(sum(CASE WHEN label % 4 = 1 THEN CASE WHEN vec_id % 10 = 0 THEN 1 ELSE vec_id / 100.0::DOUBLE END ELSE 0 END) / 512, 9) AS age FROM embeddings""")
def descriptor_terms(spark, sf_dir):
    """Terms that name a descriptor add to its scale, without a weight by 1; others do not count."""
    name = F.get(F.array(*[F.lit(n) for n in ("quality", "age", "other", "another")]), F.col("label") % 4)
    weight = F.when((F.col("label") % 4 == 1) & (F.col("vec_id") % 10 == 0), None).otherwise(F.col("vec_id") / 100.0)
    terms = _vectors(spark, sf_dir).select(name.alias("predefined_embedding"), weight.alias("weight"))
    scales = search.descriptor_scales(terms, ["quality", "age"])
    return scales.select(F.round(F.col("scales")[0], 9).alias("quality"), F.round(F.col("scales")[1], 9).alias("age"))


@query(f"""
    WITH {_sql_query()}, b AS (SELECT vec_id, label, list_dot_product(e, qv) AS score FROM ({VEC}), q ORDER BY score DESC, vec_id LIMIT 30)
    SELECT round(CAST(CAST(score AS FLOAT) AS DOUBLE), 6) AS score, 'v/' || vec_id AS url,
           replace(replace(rtrim(to_base64(unhex(substring(md5('v/' || vec_id), 1, 16))), '='), '+', '-'), '/', '_') AS hash,
           CAST(label AS BIGINT) AS formats, CASE WHEN vec_id % 2 = 0 THEN 640 END AS width, CASE WHEN vec_id % 2 = 0 THEN 480 END AS height, vec_id AS timestamp
    FROM b""")
def served_results(spark, sf_dir):
    """Result rows with their debug fields; without them the debug column is null."""
    best = search.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 30)
    known = F.col("vec_id") % 2 == 0
    found = best.select(
        "score", F.concat(F.lit("v/"), "vec_id").alias("url"), F.col("label").alias("mask"), F.when(known, 640).alias("width"), F.when(known, 480).alias("height"),
        F.array(F.lit(0.5)).alias("scores"), F.array("label").alias("shards"), F.col("vec_id").alias("timestamp"),
    )
    plain, told = search.result_rows(found), search.result_rows(found, debug=True)
    both = told.join(plain.filter("debug IS NULL").select("hash"), "hash")
    return both.select(F.round(F.col("score").cast("double"), 6).alias("score"), "url", "hash", "formats", "dimensions.width", "dimensions.height", "debug.timestamp")


@query(f"""
    WITH {_sql_query()}, s AS (SELECT vec_id, label, list_dot_product(e, qv) AS score FROM ({VEC}), q)
    SELECT vec_id, round(score, 9) AS score FROM s WHERE label < 3 ORDER BY s.score DESC, vec_id LIMIT 10""")
def no_video(spark, sf_dir):
    """Results without video frames; vectors with a label from 3 on play frames."""
    v = _vectors(spark, sf_dir).withColumn("frame", F.when(F.col("label") >= 3, F.col("label")))
    return search.top_k(search.without_video(v), _query(spark, sf_dir), 10).select("vec_id", F.round("score", 9).alias("score"))


@query()
def compared_codecs(spark, sf_dir):
    """Reconstruction errors of the codecs over all vectors; only their fitting is on a bounded sample."""
    v = _vectors(spark, sf_dir)
    models = quantize.codecs(quantize.sample_matrix(v, 1000), SUB, 16)
    errors = quantize.decoded_error(v, models).first()
    return spark.createDataFrame([(k, round(errors[k], 6)) for k in models], "codec string, error double")


@query()
def query_aware_codebooks(spark, sf_dir):
    """What the queries of every fiftieth vector miss in all vectors' codes: with a plain rotation, and with codewords and rotation made for them."""
    v = _vectors(spark, sf_dir)
    sample = quantize.sample_matrix(v, 5_000)
    moment = quantize.query_moment(asked(v))
    plain = quantize.train_pq(sample, SUB, 16)
    errors = quantize.query_error(v, {"opq": plain, "aware": quantize.query_aware(plain, sample, moment)}, moment)
    return errors.select("n", *[F.round(k, 9).alias(k) for k in ("opq", "aware")])
