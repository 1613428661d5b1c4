"""Exact dedup, with DataFrame functions only.

Rows are grouped by a 128-bit hash of the text with map-side partial aggregation
over slim rows; the row with the largest id (or the smallest) represents the
group.  In groups of more than one row the bytes of every text are compared with
those of the representative.  Texts that differ in spite of equal hashes are
grouped anew by their bytes, so a collision never merges two texts.

Every join with a side that a hot group may fill has a written table on the other
side, so adaptive execution can split the hot partition.

Defined results.  A null text counts as empty.  A null id is the smallest id.
Rows that repeat both id and text are the same document: all carry the same
decision and each counts in ``group_size``; other ties do not arise.  Very long texts are compared whole.  An
empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, hash128, lift, materialize, whole


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", hashes: tuple[Column, Column] | None = None) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` of each row.

    ``hashes`` over the column ``text`` replaces the content hash, to test collisions.
    """
    best = F.max if keep == "largest" else F.min
    h1, h2 = hashes or hash128(F.col("text"))
    d = docs.select(lift(id_col).alias("id"), whole(text_col).alias("text")).select("id", "text", h1.alias("h1"), h2.alias("h2"))
    groups = materialize(
        d.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), best("id").alias("rep")).filter("n > 1").drop("n")
    )
    digest = F.sha2("text", 256).alias("text_sha256")
    alone = d.select("id", "h1", "h2", digest).join(groups, ["h1", "h2"], "left_anti")
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    members = materialize(d.join(groups, ["h1", "h2"]).select("id", "h1", "h2", "rep", "text", digest))
    reps = materialize(members.filter("id = rep").groupBy("h1", "h2").agg(F.min("text").alias("rep_text")))
    # null where the bytes are those of the representative, else the text itself
    checked = members.join(reps, ["h1", "h2"]).select(
        "id", "h1", "h2", "text_sha256", F.when(F.col("text") != F.col("rep_text"), F.col("text")).alias("odd")
    )
    checked = checked.select("id", "h1", "h2", "text_sha256", F.coalesce("odd", F.lit("")).alias("odd"), F.col("odd").isNull().alias("same"))
    # written, so that the join above has a stage of its own, whose hot partitions are split
    checked = materialize(checked)
    key = ["h1", "h2", "odd", "same"]
    classes = materialize(checked.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id")))
    joined = checked.join(classes, key).select("id", "keep_id", "group_size", "text_sha256")
    return joined.unionByName(alone).withColumn("kept", F.col("id") == F.col("keep_id"))


def exact_report(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of each document."""
    g = exact_groups(docs)
    return g.select(give_back(F.col("id")).alias("doc_id"), give_back(F.col("keep_id")).alias("keep_id"), "group_size", "kept", "text_sha256")
