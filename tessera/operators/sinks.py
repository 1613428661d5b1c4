"""Sinks: sequenced dumps, text lines, packed indexes and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import permalink
from ..functions.vectors import fp16_encode
from .stats import descriptor_code


def append_dump(df: DataFrame, folder: str, sequence: int) -> None:
    """One numbered part of a dump; writing a number again replaces it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/sequence={sequence:06d}")


def write_vectors(df: DataFrame, path: str, order: str = "vec_id", vector: str = "embedding") -> None:
    """Vectors alone, as little-endian half-precision bytes, in files whose names and rows follow the order."""
    sorted_ = df.filter(F.col(vector).isNotNull()).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    sorted_.select(fp16_encode(vector).alias("embedding")).write.mode("overwrite").parquet(path)


def printed(kind: str, entry: dict[str, Column]) -> Column:
    """A processed entry as a line: ``record``, ``url``, ``title``, ``embedding`` or ``json``.

    ``entry`` has ``url, id, title, subreddit, author, timestamp, embedding`` and ``metadata``, a struct with
    ``final_url``.  A null field prints as nothing in a record, and is left out of JSON.
    """
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if kind == "record":
        when = F.date_format(F.timestamp_seconds(entry["timestamp"]), "yyyy-MM-dd HH:mm:ss 'UTC'")
        return F.concat(none(when), F.lit(" "), none(entry["title"]), F.lit(" "), none(permalink(entry["subreddit"], entry["id"])), F.lit(" "), none(entry["metadata"]["final_url"]))
    if kind == "embedding":
        return F.concat(F.lit("?e="), F.translate(F.base64(fp16_encode(entry["embedding"])), "+/", "-_"))
    if kind == "json":
        fields = ("url", "id", "title", "subreddit", "author", "timestamp", "embedding", "metadata")
        return F.to_json(F.struct(*[entry[f].alias(f) for f in fields]))
    return {"url": entry["url"], "title": entry["title"]}[kind]


def queued(pairs: DataFrame, path: str, iteration: str) -> None:
    """Append pairs ``a, b`` to a queue of comparisons; writing an iteration again replaces it."""
    pairs.select(F.col("a").alias("meme1"), F.col("b").alias("meme2")).write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def packed(nodes: DataFrame, cdfs: dict[int, list[float]], limits: dict[int, float] | None = None, most_bytes: int = 4094) -> DataFrame:
    """The rows of a served index: descriptor codes per channel, and ``dead`` with a blank URL.

    ``nodes`` has ``scores``.  A row is dead if it was, if a listed score is too low, or if its record is too large.
    """
    from .ranking import score_filter

    codes = F.array(*[descriptor_code(F.get("scores", k), F.array(*[F.lit(q) for q in qs])) for k, qs in sorted(cdfs.items())])
    size = F.octet_length("url") + 4 * (F.size("neighbours") + F.size("scores") + F.size("shards")) + 2 * F.size("embedding") + 24
    dead = F.col("dead") | score_filter(F.col("scores"), limits or {}) | (size > most_bytes)
    return nodes.withColumn("descriptors", codes).withColumn("dead", dead).withColumn("url", F.when(F.col("dead"), "").otherwise(F.col("url")))


def index_header(index: DataFrame) -> DataFrame:
    """Counts of live and dead rows."""
    return index.agg(F.count(F.lit(1)).alias("count"), F.count_if("dead").alias("dead_count"))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that depends on keys and seed alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def format_mask(files: DataFrame, key: str, formats: str) -> tuple[DataFrame, DataFrame]:
    """``key, mask`` and the dictionary ``format, bit``; bit 0 is for video, the rest in order of name.

    A mask has 64 bits, of which the last is the sign: more than 62 formats besides video are an error.
    """
    each = files.select(key, F.explode(formats).alias("format"))
    names = sorted(r["format"] for r in each.filter("format != 'VIDEO'").select("format").distinct().limit(63).collect())
    if len(names) > 62:
        raise ValueError("a mask holds video and at most 62 other formats")
    bits = files.sparkSession.createDataFrame([(n, k) for k, n in enumerate(["VIDEO", *names])], "format string, bit int")
    masked = each.join(F.broadcast(bits), "format").groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return masked, bits
