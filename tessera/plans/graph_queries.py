"""Queries over proximity graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vectors, to_matrix
from ..operators import graph, quantize, search, served, shards, stats
from ..operators.order import positions
from ..sources.files import table
from ..storage import materialize, state_of
from .base import query
from .search_queries import VEC, asked

KNN = f"""
knn AS (
  SELECT * FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.e, b.e) AS score,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS place
    FROM ({VEC}) a JOIN ({VEC}) b ON a.vec_id <> b.vec_id
  ) WHERE place <= 8
)"""


def _knn(spark, sf_dir):
    return graph.knn_graph(table(spark, sf_dir, "embeddings"), 8)


@query(f"WITH {KNN} SELECT src, dst, place, round(score, 9) AS score FROM knn")
def knn_graph(spark, sf_dir):
    """Exact neighbours among all vectors."""
    return _knn(spark, sf_dir).withColumn("score", F.round("score", 9))


# Edges that are close enough; some vectors have none.
CLOSE = "close AS (SELECT src, dst FROM knn WHERE score > 0.3)"


@query(f"""
    WITH {KNN}, {CLOSE}, d AS (SELECT vec_id, count(dst) AS degree FROM embeddings LEFT JOIN close ON vec_id = src GROUP BY vec_id),
    o AS (SELECT degree, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM d)
    SELECT round(avg(degree), 9) AS mean, max(degree) FILTER (WHERE i = n // 2 + 1) AS median, min(degree) AS least, max(degree) AS greatest FROM o""")
def degree_stats(spark, sf_dir):
    """Out-degrees of all vectors, those without a near neighbour included."""
    edges = _knn(spark, sf_dir).filter("score > 0.3")
    return graph.degree_stats(table(spark, sf_dir, "embeddings"), edges).withColumn("mean", F.round("mean", 9))


@query(f"""
    WITH {KNN}, twice AS (
      SELECT 0 AS shard_id, src, dst FROM knn UNION ALL SELECT 1, src, dst FROM knn WHERE place <= 3 UNION ALL SELECT 1, dst, src FROM knn WHERE place = 1
    )
    SELECT src AS id, list_aggregate(list_sort(list_distinct(list(dst))), 'string_agg', ',') AS neighbours, count(DISTINCT shard_id) AS n_shards FROM twice GROUP BY src""")
def merge_neighbours(spark, sf_dir):
    """Neighbours from two shards with local numbers of their own."""
    k = _knn(spark, sf_dir)
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    mapping = ids.select(F.lit(0).alias("shard_id"), (F.col("id") + 7).alias("local"), "id").union(ids.select(F.lit(1), F.col("id") * 3, "id"))
    local = k.select(F.lit(0).alias("shard_id"), (F.col("src") + 7).alias("src"), (F.col("dst") + 7).alias("dst"))
    local = local.union(k.filter("place <= 3").select(F.lit(1), F.col("src") * 3, F.col("dst") * 3)).union(k.filter("place = 1").select(F.lit(1), F.col("dst") * 3, F.col("src") * 3))
    out = shards.merged_neighbours(local, mapping)
    return out.select("id", F.array_join("neighbours", ",").alias("neighbours"), F.size("shards").cast("long").alias("n_shards"))


@query(f"""
    WITH RECURSIVE {KNN}, v AS ({VEC}),
    own AS (SELECT vec_id AS src, coalesce(list(dst ORDER BY dst) FILTER (WHERE dst % 10 <> 0), []) AS own FROM v LEFT JOIN knn ON vec_id = src WHERE vec_id % 10 <> 0 GROUP BY vec_id),
    offers AS (
      SELECT i.src, i.dst AS query, o.dst AS t, row_number() OVER (PARTITION BY i.src ORDER BY i.dst, list_dot_product(x.e, y.e) DESC, o.dst) AS n
      FROM knn i JOIN knn o ON i.dst = o.src JOIN v x ON x.vec_id = i.src JOIN v y ON y.vec_id = o.dst WHERE i.dst % 10 = 0 AND i.src % 10 <> 0 AND i.src <> o.dst
    ), steps(src, n, query, added, own, new) AS (
      SELECT src, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0, own, CAST([] AS BIGINT[]) FROM own
      UNION ALL
      SELECT s.src, o.n, o.query,
             CASE WHEN o.query = s.query THEN s.added ELSE 0 END + CASE WHEN {{takes}} THEN 1 ELSE 0 END, s.own, CASE WHEN {{takes}} THEN list_append(s.new, o.t) ELSE s.new END
      FROM steps s JOIN offers o ON o.src = s.src AND o.n = s.n + 1
    ), last AS (SELECT src, own, arg_max(new, n) AS new FROM steps GROUP BY src, own)
    SELECT src, unnest(own) AS dst, false AS added FROM last UNION ALL SELECT src, unnest(new), true FROM last""".replace(
        "{takes}", "CASE WHEN o.query = s.query THEN s.added ELSE 0 END < 4 AND len(s.own) + len(s.new) < 10 AND NOT list_contains(s.own, o.t) AND NOT list_contains(s.new, o.t)"
    ))
def stitch(spark, sf_dir):
    """Every tenth vector plays a query node; four edges a query at most, and ten in all."""
    v = table(spark, sf_dir, "embeddings")
    return graph.stitch(_knn(spark, sf_dir), v, v.filter("vec_id % 10 = 0"), 4, 10)


@query(f"WITH {KNN}, s AS (SELECT label AS shard_id, count(*) AS size FROM ({VEC}) GROUP BY label) SELECT shard_id, size, CAST(coalesce(sum(size) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def shard_offsets(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("shard_id")).agg(F.count(F.lit(1)).alias("size"))
    return shards.shard_offsets(sizes).withColumnRenamed("offset", "start")


_built: dict[tuple, DataFrame] = {}

#: Vectors of a shard of the graph, about; a shard is built in one task.  Every shard is searched for every query, so shards grow up to
#: ``LARGEST`` before they become more than ``MOST_SHARDS``.
SHARD_ROWS = 2_000
MOST_SHARDS = 48
LARGEST = 20_000


def _centroids(v):
    """Three shards by label, or as many as the rows need."""
    n = v.count()
    if n <= 3 * SHARD_ROWS:
        return mean_vectors(v.withColumn("part", F.col("label") % 3), "part").select(F.col("part").cast("long").alias("shard_id"), "centroid")
    return shards.spherical_kmeans(v, max(min(-(-n // SHARD_ROWS), MOST_SHARDS), -(-n // LARGEST)), balance=0.05)


def _graph(spark, sf_dir):
    """The vectors and their graph, which is built and written once in a session, as long as the table's files stay as they are."""
    v = table(spark, sf_dir, "embeddings")
    at = spark.sparkContext.applicationId, sf_dir, state_of(v)
    if at not in _built:
        assigned = shards.nearest_shards(v, _centroids(v), 2)
        # with longer edges (an alpha above 1) a family of over 24 near copies has edges to itself alone, and a search that starts there ends there
        _built[at] = materialize(graph.build_graphs(assigned, v, degree=24, width=48, most=200, passes=1, alpha=1.0))
    return v, _built[at]


@query()
def packed_search(spark, sf_dir):
    """Search on the packed table for every fiftieth vector: recall of the ten nearest, and nodes read by a query."""
    v, g = _graph(spark, sf_dir)
    model = quantize.train_pq(quantize.sample_matrix(v), 16, 64, rounds=6)
    nodes = served.write_packed(served.packed_nodes(g, v, model), 16)
    starts = g.filter("is_start").select("shard_id", "id")
    found = materialize(served.packed_search(nodes, asked(v), starts, _centroids(v), model, 10, width=100, expand=16, probes=3))
    reads = found.select("query_id", "reads").distinct().agg(F.round(F.avg("reads"), 6).alias("mean_reads"), F.max("reads").alias("most_reads"))
    share = stats.recall(_truth(v, asked(v), 10), found, 10).select("queries", F.round("recall", 6).alias("recall"))
    return share.crossJoin(F.broadcast(reads)).crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("nodes"))))


@query()
def proximity_graph(spark, sf_dir):
    """A pruned graph per shard: sizes, degrees and one start each."""
    _, g = _graph(spark, sf_dir)
    return g.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("neighbours")).alias("most"), F.count_if("is_start").alias("starts"))


def _truth(v, queries, k):
    return search.batch_top_k(v, queries, k)


def _beam(g, v, k, **how):
    """Beam search for every fiftieth vector; queries are sent in blocks as in ``search.batch_top_k``."""
    queries = asked(v)
    n = queries.count()
    blocks = 1 if n <= search.MAX_QUERIES else -(-2 * n // search.MAX_QUERIES)
    parts = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").orderBy("query_id").toArrow()
        if rows.num_rows:
            parts.append(graph.beam_search(g, v, to_matrix(rows.column(1)), k, query_ids=rows.column(0).to_numpy(), **how))
    return reduce(DataFrame.unionByName, parts)


@query()
def beam_search(spark, sf_dir):
    v, g = _graph(spark, sf_dir)
    return _beam(g, v, 10, width=100).withColumn("score", F.round("score", 9))


@query()
def recall_at_k(spark, sf_dir):
    """Recall of beam search in all shards against exact search, over every fiftieth vector."""
    v, g = _graph(spark, sf_dir)
    found = _beam(g, v, 20, width=120)
    return stats.recall(_truth(v, asked(v), 20), found, 20).select("queries", F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.9).alias("at_least_90"))


@query(f"""
    WITH t AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM ({VEC}) a, ({VEC}) b WHERE a.vec_id % 50 = 0)),
    f AS (SELECT query_id, vec_id FROM t WHERE n <= 20 AND vec_id % 7 <> 0)
    SELECT count(f.vec_id) AS hits, count(DISTINCT t.query_id) AS queries, round(count(f.vec_id) / (count(DISTINCT t.query_id) * 20.0), 9) AS recall
    FROM t LEFT JOIN f ON t.query_id = f.query_id AND t.vec_id = f.vec_id WHERE t.n <= 20""")
def recall_exact(spark, sf_dir):
    """Recall, over every fiftieth vector, of an index that lost every seventh."""
    v = table(spark, sf_dir, "embeddings")
    truth = _truth(v, asked(v), 20)
    return stats.recall(truth, truth.filter("vec_id % 7 != 0"), 20).withColumn("recall", F.round("recall", 9))


@query(f"""
    WITH q AS (SELECT e AS qv FROM ({VEC}) WHERE vec_id = 0),
    r AS (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(e, qv) DESC, vec_id) - 1 AS r FROM ({VEC}), q),
    s AS (SELECT r, row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS n FROM r)
    SELECT round(avg(r) + 1, 9) AS mean, max(r) FILTER (WHERE i = n // 2 + 1) + 1 AS median, min(r) AS least, max(r) AS greatest, round(count(*) / sum(1 / (r + 1.0::DOUBLE)), 9) AS harmonic FROM s""")
def rank_summary(spark, sf_dir):
    """Where all vectors stand in the exact order of a query."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("query"))
    scored = v.crossJoin(F.broadcast(q)).select("vec_id", dot("embedding", "query").alias("score"))
    ranks = positions(scored, [F.col("score").desc(), F.col("vec_id")]).select(F.col("place").alias("rank"))
    s = stats.rank_summary(ranks, "rank")
    return s.withColumns({c: F.round(c, 9) for c in ("mean", "harmonic")})


@query()
def coded_beam_search(spark, sf_dir):
    """Beam search steered by product codes: recall against exact search."""
    v, g = _graph(spark, sf_dir)
    model = quantize.train_pq(quantize.sample_matrix(v), 16, 64, rounds=6)
    found = _beam(g, v, 10, width=150, quantizer=model)
    return stats.recall(_truth(v, asked(v), 10), found, 10).select("queries", F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.9).alias("at_least_90"))
