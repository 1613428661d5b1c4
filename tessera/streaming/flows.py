"""Structured Streaming: ingest, deduplication, windows and telemetry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import shards
from .keyed import KeyedTable


def source(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16, form: str = "parquet") -> DataFrame:
    """A folder as a stream; the number of files in a batch is the back-pressure."""
    return spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files_per_batch).load(path)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def telemetry_daily(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Events per day and kind; days close when the watermark has passed them."""
    t = event_time(events, at)
    if t.isStreaming:
        t = t.withWatermark(at, late)
    return t.groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def sliding(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 day", step: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Events per overlapping window and kind."""
    t = event_time(events, at)
    if t.isStreaming:
        t = t.withWatermark(at, late)
    return t.groupBy(F.window(at, width, step).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(events: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per session of a user."""
    t = event_time(events, at)
    if t.isStreaming:
        t = t.withWatermark(at, late)
    return t.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], at: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows with new keys: for ever, or with ``at`` only within the watermark, which bounds the state."""
    if at is None:
        return stream.dropDuplicates(keys)
    return event_time(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def past(stream: DataFrame, threshold, at: str = "ts") -> DataFrame:
    """Rows strictly later than the point that an earlier run reached."""
    return stream.filter(F.col(at) > F.lit(threshold))


def balanced(stream: DataFrame, centroids: DataFrame, fudge: float = 0.2, lanes: int = 8, key: str = "vec_id", vector: str = "embedding", n: int = 2) -> DataFrame:
    """``vec_id, shard_id, choice, score`` of a stream by the law of :class:`~tessera.operators.shards.Balance`.

    Each lane's counts are state, so later batches and restarts go on from them.  Within a batch records count in the order of their keys; the
    batch's size (``files_per_batch``) bounds what a lane holds.  ``lanes`` stays as it was when the stream began.
    """
    ids, m = shards.checked_centroids(centroids)

    def deal(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, seen = state.get if state.exists else (None, 0)
        balance = shards.Balance(len(ids), counts, seen)
        rows = pd.concat(list(frames)).sort_values(key, kind="stable")
        yield shards.dealt_frame(balance, rows, ids, m, fudge, n, key, vector)
        state.update((balance.counts.tolist(), balance.seen))

    laned = stream.filter(F.col(vector).isNotNull()).select(key, vector, F.pmod(F.col(key).cast("long"), F.lit(lanes)).alias("lane"))
    out = f"{key} long, shard_id long, choice long, score double"
    return laned.groupBy("lane").applyInPandasWithState(deal, out, "counts array<long>, seen long", "append", GroupStateTimeout.NoTimeout)


def upsert_into(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the newest row of each key as a :class:`~tessera.streaming.keyed.KeyedTable`; a batch writes only the buckets it touches.

    A repeated batch gives the same version.
    """

    def batch(rows: DataFrame, number: int) -> None:
        KeyedTable(rows.sparkSession, path, key, order, buckets).apply(rows, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest finished version of an upserted table; null without any."""
    return KeyedTable(spark, path, "", "").read()


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Telemetry as it comes: an exactly-once append."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """One stream to several sinks: each batch is read once and written, as each sink makes it, to ``<path>/<sink>/batch=<number>``.

    A batch that is repeated after a failure writes the same folders again, so each sink has every row once.  Sinks of a batch that broke off in between
    may be a batch apart until it is repeated.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for name, made in sinks.items():
                made(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newly_seen(stream: DataFrame, feed: str, key: str, order: str, most: int = 200) -> DataFrame:
    """Rows of a feed whose key is not among the last ``most`` that the feed gave, in the order of ``order`` within a batch.

    The state of a feed is bounded: ``most`` keys.  A key that comes back after so many others is new again.
    """
    fields = stream.schema

    def fresh(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([order, key], kind="stable")
        known, new = set(seen), []
        for k in rows[key].tolist():
            new.append(k not in known)
            if new[-1]:
                seen.append(k)
                known.add(k)
                if len(seen) > most:
                    known.discard(seen.pop(0))
        state.update((seen,))
        yield rows[np.array(new, bool)]

    kind = fields[key].dataType.simpleString()
    return stream.groupBy(feed).applyInPandasWithState(fresh, fields, f"seen array<{kind}>", "append", GroupStateTimeout.NoTimeout)


def poll_interval(gaps: list[float], least: float = 1.0, most: float = 3600.0) -> float:
    """How long to wait for a feed: its mean gap, within bounds."""
    return min(most, max(least, sum(gaps) / len(gaps))) if gaps else most
