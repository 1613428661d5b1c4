"""Raw record dumps: lines of JSON, from text to typed entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .zstd_lines import read_zstd_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines of text files, compressed or not; Zstandard files may have windows of up to 2^31 bytes."""
    return read_zstd_lines(spark, path).select("value") if path.endswith(".zst") else spark.read.text(path)


def parse(lines: DataFrame) -> DataFrame:
    """Typed entries; rejected and broken lines drop out one by one.

    The rejecting patterns run on raw text, before any parsing.  A missing ``post_hint`` is ``na``; an
    explicit null stays null.
    """
    kept = lines.filter(~T.line_rejected(F.col("value")))
    v = kept.select("value", F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    hint = F.when(F.array_contains(F.json_object_keys("value"), "post_hint"), get("post_hint", "string")).otherwise("na")
    out = v.select(
        get("url", "string").alias("url"), get("over_18", "boolean").alias("over_18"), get("title", "string").alias("title"),
        get("author", "string").alias("author"), get("selftext", "string").alias("selftext"), get("subreddit", "string").alias("subreddit"),
        T.epoch_seconds(get("created_utc", "string")).alias("timestamp"), hint.alias("post_hint"), get("id", "string").alias("id"),
    )
    return out.dropna(subset=["url", "over_18", "title", "selftext", "timestamp", "id"])


def accept(entries: DataFrame, after: int | None = None) -> DataFrame:
    """Entries worth fetching, cheap tests first; only those later than ``after``."""
    out = entries.filter((F.col("selftext") == "") & ~F.col("over_18") & F.col("author").isNotNull() & F.col("subreddit").isNotNull())
    out = out.filter(F.col("post_hint").isin(T.POST_HINTS))
    if after is not None:
        out = out.filter(F.col("timestamp") > after)
    return out.filter(T.url_accepted(F.col("url")))


def projected(entries: DataFrame) -> DataFrame:
    """What goes on to be fetched, with the rewritten URL."""
    return entries.select(T.url_rewritten(F.col("url")).alias("url"), "id", "title", "subreddit", "author", "timestamp")


def sampled(df: DataFrame, rate: float, key: str = "id", seed: int = 0) -> DataFrame:
    """A sample that depends on keys alone, so that every run has the same."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.filter(h % 1_000_000 < rate * 1_000_000)
