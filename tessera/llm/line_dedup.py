"""Line dedup, with DataFrame functions only.

Every document is split at ``\\n``.  The key of a line is the line without
blanks at its ends and with A-Z lower-cased.  A key of at least ``min_chars``
code points that is found in at least ``min_docs`` documents loses all its lines
but those in one document: that with the largest id (or the smallest).

The index of long lines (128-bit key hash, document, position) is written once.
Keys that hold more than a fraction of it (a quarter of what a partition holds, or 1 / ``HOT_SHARES`` if that is
less, so their number is bounded and follows the number of partitions) are counted with map-side partial aggregation and joined by
broadcast: no task meets all their lines.  All other lines are range-partitioned by
hash and sorted by hash, document and position; one pass over each sorted
partition finds the first document of each key and how many documents have it.
What comes back is not text but a bitmap for each document with dropped lines,
compressed to alternating run lengths (kept, dropped, kept, ...).

Defined results.  A null or empty text has one empty line.  A null id is the
smallest id.  Rows with the same id are one document where documents are
counted, and each is edited on its own.  An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, hash128, lift, lower_ascii, materialize, strip_blanks, whole

HOT_SHARES = 1024
#: What Spark's sketch of frequent items takes at most.
_MOST_TRACKED = 1_000_000


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``id, version, pos, h1, h2`` of every line that is long enough.

    ``version`` is a hash of the whole text, so that rows with the same id are told apart.
    """
    base = docs.select(lift(id_col).alias("id"), whole(text_col).alias("text"))
    lines = base.select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.withColumn("line", strip_blanks(F.col("line"))).filter(F.length("line") >= min_chars)
    h1, h2 = hash128(lower_ascii(F.col("line")))
    return bare.select("id", "version", "pos", h1.alias("h1"), h2.alias("h2"))


def hot_shares(parts: int) -> int:
    """A key is hot if it holds more than one in so many of all lines."""
    return min(max(HOT_SHARES, 4 * parts), _MOST_TRACKED // 16)


def dropped_lines(index: DataFrame, min_docs: int = 5, keep: str = "largest") -> DataFrame:
    """``id, version, pos`` of the lines to drop, from a written line index."""
    spark = index.sparkSession
    last = F.max if keep == "largest" else F.min
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = hot_shares(parts)
    total, top = index.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h1, {shares}, {16 * shares})")).first()
    # the counts steer only how lines travel, never which are dropped
    hot_keys = [(t["item"],) for t in top or [] if t["count"] * shares > max(total, shares * 1000)]
    hot = F.broadcast(spark.createDataFrame(hot_keys, "h1 long"))
    cold = index.join(hot, "h1", "left_anti") if hot_keys else index
    order = F.col("id").desc() if keep == "largest" else F.col("id").asc()
    key = Window.partitionBy("h1", "h2")
    streamed = (
        cold.repartitionByRange(parts, "h1", "h2")
        .sortWithinPartitions("h1", "h2", order, "pos")
        .withColumn("place", F.dense_rank().over(key.orderBy(order)))
        .withColumn("docs", F.max("place").over(key))
    )
    dropped = streamed.filter((F.col("place") > 1) & (F.col("docs") >= min_docs)).select("id", "version", "pos")
    if not hot_keys:
        return dropped
    hot_lines = index.join(hot, "h1")
    stats = (
        hot_lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), last("id").alias("stays"))
        .filter(F.col("docs") >= min_docs)
    )
    return dropped.unionByName(
        hot_lines.join(F.broadcast(stats), ["h1", "h2"]).filter(F.col("id") != F.col("stays")).select("id", "version", "pos")
    )


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``id, version, runs``: per document, lines kept, dropped, kept, ... in turn.

    Lines after the last run are kept.
    """
    sets = dropped.groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    edges = sets.select("id", "version", starts.alias("s"), ends.alias("e"))
    runs = F.flatten(
        F.transform(F.arrays_zip("s", "e", F.concat(F.array(F.lit(-1)), F.col("e")).alias("p")),
                    lambda r: F.array(r["s"] - r["p"] - 1, r["e"] - r["s"] + 1))
    )
    # p has one element more than s and e; the last zipped row is empty
    return edges.select("id", "version", F.filter(runs, lambda n: n.isNotNull()).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep: str = "largest") -> DataFrame:
    """Keep bitmaps: ``id, version, runs`` for each document that loses a line."""
    return keep_bitmaps(dropped_lines(materialize(line_index(docs, id_col, text_col, min_chars)), min_docs, keep))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` inside ``doc``, with ``n_lines, n_dropped, kept_text``."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), lift(id_col).alias("id"), whole(text_col).alias("text"))
    # bitmaps are in proportion to the documents, so they are never sent to all tasks
    d = d.withColumn("version", F.xxhash64("text")).join(bitmaps.hint("merge"), ["id", "version"], "left")
    flags = F.flatten(F.transform(F.coalesce("runs", F.array().cast("array<int>")), lambda n, i: F.array_repeat(i % 2 == 0, n)))
    d = d.select("doc", "id", "text", F.split("text", "\n", -1).alias("lines"), "runs", flags.alias("flags"))
    kept = F.transform(
        F.filter(F.arrays_zip("lines", "flags"), lambda z: z["lines"].isNotNull() & F.coalesce(z["flags"], F.lit(True))),
        lambda z: z["lines"],
    )
    return d.select(
        "doc", "id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("flags", lambda f: ~f)).cast("long").alias("n_dropped"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each document."""
    out = apply_bitmaps(docs, line_dedup(docs))
    return out.select(give_back(F.col("id")).alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def line_stage(docs: DataFrame) -> DataFrame:
    """The documents with their kept lines as text; ``n_chars`` follows."""
    out = apply_bitmaps(docs, line_dedup(docs))
    swap = {"text": F.when(F.col("doc.text").isNotNull(), F.col("kept_text")), "n_chars": F.when(F.col("doc.text").isNotNull(), F.length("kept_text").cast("long"))}
    return out.select(*[(swap[c] if c in swap else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
