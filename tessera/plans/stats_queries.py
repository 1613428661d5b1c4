"""Queries that describe data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, stats
from ..operators.order import running
from ..sources.files import table
from .base import query
from .search_queries import VEC

DIMS = f"SELECT vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ({VEC})"


@query("SELECT count(*) AS n, min(ts) AS earliest, max(ts) AS latest, count(*) FILTER (WHERE value > 50) AS large FROM events")
def min_max_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def high_water(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY event_type, part")
def label_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH b AS (SELECT lang, len(list_filter(list_transform(range(29), lambda k: 100.0::DOUBLE * pow(1.5::DOUBLE, k)), lambda q: q < n_chars)) AS bin FROM documents),
    c AS (SELECT lang, bin, count(*) AS n FROM b GROUP BY lang, bin)
    SELECT lang, CAST(bin AS INTEGER) AS bin, n, CAST(sum(n) OVER (PARTITION BY lang ORDER BY bin) AS BIGINT) AS cumulative FROM c""")
def exp_histogram(spark, sf_dir):
    return stats.exponential_histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), "lang", 100.0, 1.5, 29)


@query("""
    WITH q AS (SELECT event_type, unnest(quantile_cont(value, list_transform(range(255), lambda k: k / 254.0::DOUBLE))) AS x, unnest(range(255)) AS pos FROM events GROUP BY event_type)
    SELECT event_type, pos, round(x, 6) AS x FROM q""")
def cdf_255(spark, sf_dir):
    c = stats.cdf(table(spark, sf_dir, "events"), "value", "event_type")
    return c.select("event_type", F.posexplode("cdf").alias("pos", "x")).select("event_type", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""
    WITH e AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, event_type FROM events),
    g AS (SELECT event_type, s - lag(s) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM e)
    SELECT event_type, round(avg(gap), 3) AS mean_gap, count(gap) AS gaps FROM g GROUP BY event_type""")
def interarrival(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return stats.inter_arrival(e, "s", "event_id", "event_type").withColumn("mean_gap", F.round("mean_gap", 3))


@query("""
    WITH w AS (SELECT event_type, event_id, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 49 PRECEDING) AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
    SELECT event_type, event_id, round(r, 6) AS rolling FROM w WHERE n >= 50""")
def rolling_mean(spark, sf_dir):
    r = stats.rolling_mean(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "value", "event_id", 50, "event_type")
    return r.select("event_type", "event_id", F.round("rolling", 6).alias("rolling"))


ROC = """
d AS (SELECT n_chars AS score, quality = 1 AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
s AS (SELECT score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM d GROUP BY score),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s)"""


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("y"))


@query(f"WITH {ROC} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def roc_curve(spark, sf_dir):
    return stats.roc(_labelled(spark, sf_dir), "score", "y").select("score", "tp", "fp")


@query(f"""
    WITH {ROC}, t AS (SELECT tp, fp, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0 FROM c)
    SELECT round(sum((fp - fp0) * (tp + tp0) / 2.0::DOUBLE) / (max(tp) * max(fp)), 9) AS auroc FROM t""")
def auroc(spark, sf_dir):
    return stats.auroc(_labelled(spark, sf_dir), "score", "y").select(F.round("auroc", 9).alias("auroc"))


@query(f"""
    WITH d AS ({DIMS}), m AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS dev FROM d GROUP BY pos),
    z AS (SELECT d.pos, CAST(greatest(0, least(63, floor(((x - mean) / dev + 4) / 8 * 64))) AS INTEGER) AS bin FROM d JOIN m ON d.pos = m.pos)
    SELECT pos, bin, count(*) AS n FROM z GROUP BY pos, bin""")
def standardised_histogram(spark, sf_dir):
    h = stats.standardised_histogram(table(spark, sf_dir, "embeddings"))
    return h.select(F.col("pos").cast("long").alias("pos"), "bin", "n")


@query(f"""
    WITH d AS ({DIMS}), m AS (SELECT pos, avg(x) AS mean FROM d GROUP BY pos),
    c AS (SELECT a.pos AS i, b.pos AS j, avg(a.x * b.x) AS xy FROM d a JOIN d b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos)
    SELECT i, j, round(xy - mi.mean * mj.mean, 9) AS cov FROM c JOIN m mi ON i = mi.pos JOIN m mj ON j = mj.pos""")
def covariance(spark, sf_dir):
    """Of all dimensions."""
    return ranking.covariance(table(spark, sf_dir, "embeddings")).withColumn("cov", F.round("cov", 9))


@query()
def principal_components(spark, sf_dir):
    parts, share = ranking.principal_components(table(spark, sf_dir, "embeddings"), 4)
    return spark.createDataFrame([(k, round(float(s), 9), [round(float(x), 6) for x in p]) for k, (s, p) in enumerate(zip(share, parts, strict=True))], "component int, share double, vector array<double>")


@query("""
    WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
    l AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS level)
    SELECT level, doc_id, place FROM r, l WHERE place >= round(level * n) AND place < round(level * n) + 25""")
def percentile_slices(spark, sf_dir):
    s = stats.percentile_slice(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], [0.05, 0.25, 0.5, 0.75, 0.95])
    return s.select("level", "doc_id", F.col("place").cast("long").alias("place"))


@query("""
    SELECT user_id % 10 AS member, round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS median, round(var_samp(value), 6) AS variance FROM events GROUP BY member""")
def ensemble_stats(spark, sf_dir):
    e = stats.ensemble(table(spark, sf_dir, "events").withColumn("member", F.col("user_id") % 10), "member", score="value")
    return e.select("member", F.round("mean", 9).alias("mean"), "median", F.round("variance", 6).alias("variance"))


@query("SELECT event_type, min(value) AS least FROM events GROUP BY event_type")
def best_loss(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("least"))


@query("""
    WITH f AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
    SELECT event_type, user_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place FROM f) WHERE place <= 5""")
def exemplars(spark, sf_dir):
    """Where each feature is strongest."""
    f = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    e = ranking.exemplars(f, 5, "user_id")
    return e.select(F.col("feature").alias("event_type"), "user_id", F.col("value").alias("n"), F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM documents")
def prefix_sums(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return running(d, {"running": F.col("n_chars")}, [F.col("doc_id")], ["source"]).select("doc_id", "running")


@query("""
    WITH x AS (SELECT n_chars, count(*) AS n, min(doc_id) AS class FROM documents GROUP BY n_chars),
    l AS (SELECT a.n_chars, sum(b.n) AS links FROM x a JOIN x b ON abs(a.n_chars / 1000.0::DOUBLE - (b.n_chars / 1000.0::DOUBLE + 1e-12)) < 1e-10 GROUP BY a.n_chars)
    SELECT doc_id, class, CAST(links AS BIGINT) AS links FROM documents d JOIN x ON d.n_chars = x.n_chars JOIN l ON d.n_chars = l.n_chars""")
def tolerance_join(spark, sf_dir):
    """Numbers that agree within a tolerance, joined on buckets of its width: class and number of links of each document.

    Equal values are grouped before they are joined.  Values are whole numbers of thousandths, so that
    those within the tolerance are equal ones and a class is a value's documents.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    eps = 1e-10
    x = d.groupBy("n_chars").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("class"))
    a = x.select("n_chars", "class", (F.col("n_chars") / 1000.0).alias("x")).withColumn("bucket", F.floor(F.col("x") / eps))
    b = x.select("n", (F.col("n_chars") / 1000.0 + 1e-12).alias("y"))
    b = b.withColumn("bucket", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.floor(F.col("y") / eps) + k)))
    links = a.join(b, "bucket").filter(F.abs(F.col("x") - F.col("y")) < eps).groupBy("n_chars", "class").agg(F.sum("n").alias("links"))
    return d.join(links, "n_chars").select("doc_id", "class", "links")
