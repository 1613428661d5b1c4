"""Streaming flows, run to their end over a table and returned as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import mean_vectors
from ..sources.files import table
from ..storage import fresh_path
from ..streaming import flows
from .base import query
from .search_queries import balanced_fold


def _events(spark, sf_dir):
    """The events as a stream: a written copy, as a file source reads folders."""
    at = fresh_path(spark, "flow")
    table(spark, sf_dir, "events").write.parquet(at)
    return flows.source(spark, at, table(spark, sf_dir, "events").schema)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def telemetry_daily(spark, sf_dir):
    d = flows.telemetry_daily(table(spark, sf_dir, "events"))
    return d.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, value FROM events) GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """Unbounded exact deduplication of a stream, appended to a table."""
    at = fresh_path(spark, "flow")
    unique = flows.deduplicated(_events(spark, sf_dir), ["event_type", "user_id", "value"]).select("event_type", "user_id", "value")
    flows.append(unique, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark, sf_dir):
    """The newest event of each user, kept by batches."""
    at = fresh_path(spark, "flow")
    stream = _events(spark, sf_dir).select("user_id", "event_id", "value")
    flows.upsert_into(stream, f"{at}/table", "user_id", "event_id", f"{at}/checkpoint").awaitTermination()
    return flows.current(spark, f"{at}/table").select("user_id", "event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def stream_resume(spark, sf_dir):
    """A run that goes on where another ended."""
    at = fresh_path(spark, "flow")
    later = flows.past(_events(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")
    flows.append(later, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, part""")
def user_sessions(spark, sf_dir):
    s = flows.sessions(table(spark, sf_dir, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events WHERE CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Days that the watermark has closed."""
    at = fresh_path(spark, "flow")
    daily = flows.telemetry_daily(_events(spark, sf_dir))
    flows.append(daily, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, value FROM events) GROUP BY 1, 2")
def stream_dedup_watermark(spark, sf_dir):
    """Deduplication whose state ends with the watermark, which is later than all copies here."""
    at = fresh_path(spark, "flow")
    unique = flows.deduplicated(_events(spark, sf_dir), ["event_type", "user_id", "value"], "ts", "60 days").select("event_type", "user_id", "value")
    flows.append(unique, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH e AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, event_id % 4 <> 3 AS first FROM events),
    w AS (SELECT max(ts) FILTER (WHERE event_id % 2 = 0) - INTERVAL 1 HOUR AS early, max(ts) - INTERVAL 1 HOUR AS late FROM events)
    SELECT day, event_type, count(*) AS n FROM e, w WHERE day + INTERVAL 1 DAY <= late AND (first OR day + INTERVAL 1 DAY > early) GROUP BY day, event_type""")
def stream_late_rows(spark, sf_dir):
    """A quarter of the events comes two batches after the first: those of days that the first one's watermark closed are dropped."""
    at = fresh_path(spark, "flow")
    events = table(spark, sf_dir, "events")
    for some in ("event_id % 2 = 0", "event_id % 4 = 1", "event_id % 4 = 3"):
        events.filter(some).coalesce(1).write.mode("append").parquet(f"{at}/in")
    daily = flows.telemetry_daily(flows.source(spark, f"{at}/in", events.schema, files_per_batch=1))
    flows.append(daily, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""
    WITH s AS (SELECT event_type, time_bucket(INTERVAL 12 HOURS, ts) AS b FROM events)
    SELECT start, event_type, count(*) AS n FROM (SELECT b AS start, event_type FROM s UNION ALL SELECT b - INTERVAL 12 HOURS, event_type FROM s) GROUP BY start, event_type""")
def sliding_counts(spark, sf_dir):
    """Overlapping windows of a day, one every twelve hours."""
    s = flows.sliding(table(spark, sf_dir, "events"))
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(balanced_fold("vec_id % 3", "vec_id % 4, vec_id"))
def stream_balanced(spark, sf_dir):
    """Vectors come in four files; each lane goes on from the counts that the batches before left, though the stream is started anew for each."""
    at = fresh_path(spark, "flow")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    centroids = mean_vectors(v, "label").withColumnRenamed("label", "shard_id").select("shard_id", "centroid")
    for some in range(4):
        v.filter(F.col("vec_id") % 4 == some).select("vec_id", "embedding").coalesce(1).write.mode("append").parquet(f"{at}/in")
        flow = flows.balanced(flows.source(spark, f"{at}/in", "vec_id long, embedding array<float>", files_per_batch=1), centroids, lanes=3)
        flows.append(flow, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("vec_id", F.col("shard_id").cast("int").alias("shard_id"), "choice", F.round("score", 9).alias("score"))
