"""Mixing sources to target weights.

Sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words.  No target passes ``most`` times its source's words; what
is above is shared again by weight until none is above (water filling, in closed
form over the table of sources).

Documents of a source are ordered by a hash-random key of id and text.  The sizes are written once.  Key ranges (blocks) of
about ``block_rows`` documents are sorted on their own; the words before a block
come from a prefix sum over block sums, the words before a document from
a running sum within its block.  The order is cut at the source's exact budget: every
document is taken in each whole epoch, those before the cut once more, the
document at the cut in part.  A hot source has more blocks, not larger ones.

Defined results.  A null text has no words; a null source is a source of its own; a
null id is the smallest id.  Documents without words, and sources without words, are
taken 0 times.  Rows that repeat an id are mixed on their own, in an order of their texts; rows that repeat
id and text stand together, and a block that they fill is cut at them.  Ties of a source's fill go by its name.  A very long
text is one document, which the cut may take in part.  An empty table gives an empty result.  The order
depends on ids, texts and ``seed`` alone, so reruns agree.  Other columns are ignored, whatever their
names; the stage hands them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, give_back, lift, materialize, whole, word_count

WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """A row per source: ``source, source_size, rows, target``.

    The windows here run over the table of sources, after aggregation.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    s = s.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(named) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumns({
        "at": F.row_number().over(filling),
        "below": F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "above": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("below")) / F.col("above"))
    s = s.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    first = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * first)
    return s.select("source", "source_size", "rows", target.alias("target"))


def _cuts(slim: DataFrame, large: DataFrame, block_rows: int) -> DataFrame:
    """``c_source, c_block, keys``: the keys that more than ``block_rows`` rows of a large block share, in order.

    Keys are hashes, so a block has few of these, however many rows repeat.
    """
    at = large.select(F.col("source").alias("c_source"), F.col("block").alias("c_block"))
    rows = slim.join(at, slim["source"].eqNullSafe(at["c_source"]) & (slim["block"] == at["c_block"]))
    often = rows.groupBy("c_source", "c_block", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows)
    pair = F.struct("key", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    return materialize(often.groupBy("c_source", "c_block").agg(F.sort_array(F.collect_list(pair)).alias("keys")))


def _segments(dealt: DataFrame, cut: DataFrame, block_rows: int) -> DataFrame:
    """Add ``segment`` and ``sub``, which keep the order by key: a key that repeats too often is a segment of its own.

    Its rows have one id and one text, hence one size, so it doesn't matter which of them is in which part.
    """
    rows = dealt.join(cut, dealt["source"].eqNullSafe(cut["c_source"]) & (dealt["block"] == cut["c_block"]), "left")
    below = F.coalesce(F.size(F.filter("keys", lambda k: k["key"] < F.col("key"))), F.lit(0))
    own = F.get(F.filter("keys", lambda k: k["key"] == F.col("key")), F.lit(0))["parts"]
    return rows.withColumns({
        "segment": F.when(F.col("keys").isNull(), 0).otherwise(2 * below + F.when(own.isNotNull(), 1).otherwise(0)),
        "sub": F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), own), F.lit(0)).cast("int"),
    }).drop("c_source", "c_block", "keys")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, seed: str = "mix", block_rows: int = 2_000, **targets) -> DataFrame:
    """``id, size, source_size, target, taken`` of each row; ``carry`` adds ``doc``, the row itself."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    text = whole(text_col)
    sized = docs.select(
        lift(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), lift(id_col).cast("string"), F.md5(text))).alias("key"), *row,
    )
    sized = materialize(sized)
    sources = materialize(source_targets(sized.select("source", "size"), **targets))
    same = sized["source"].eqNullSafe(sources["source"])
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(2**32)
    deal = F.floor(part * F.ceil(F.col("rows") / block_rows)).cast("long")
    dealt = sized.join(sources, same).drop(sources["source"]).withColumn("block", deal)
    slim = sized.select("source", "size", "key").join(sources, same).drop(sources["source"]).withColumn("block", deal)
    uncut = {"segment": F.lit(0), "sub": F.lit(0)}
    sums = materialize(slim.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).withColumns(uncut))
    large = sums.filter(F.col("n") > 4 * block_rows)
    if large.isEmpty():
        dealt = dealt.withColumns(uncut)
    else:
        cut = _cuts(slim, large, block_rows)
        dealt = materialize(_segments(dealt, cut, block_rows))
        sums = dealt.groupBy("source", "block", "segment", "sub").agg(F.sum("size").alias("words"))
    earlier_blocks = Window.partitionBy("source").orderBy("block", "segment", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s_source"), F.col("block").alias("s_block"), F.col("segment").alias("s_segment"), F.col("sub").alias("s_sub"),
        F.coalesce(F.sum("words").over(earlier_blocks), F.lit(0)).alias("before"),
    )
    in_block = Window.partitionBy("source", "block", "segment", "sub").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("earlier", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    alike = placed["source"].eqNullSafe(sums["s_source"])
    for c in ("block", "segment", "sub"):
        alike = alike & (placed[c] == sums[f"s_{c}"])
    placed = placed.join(sums, alike)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("earlier")
    out = placed.withColumn("epochs", epochs)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["doc"] if carry else []))


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each document."""
    return mix(docs).select(give_back(F.col("id")).alias("doc_id"), "size", "source_size", "target", "taken")


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken.

    A document that is taken in part ends after the word where the cut falls.
    """
    m = mix(docs, carry=True).filter("taken > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    head = F.array_join(F.slice(F.split(F.btrim(F.col("doc.text"), F.lit(BLANKS)), "[ \\t\\n\\x0B\\f\\r]+"), F.lit(1), words.cast("int")), " ")
    text = F.when(words >= F.col("size"), F.col("doc.text")).otherwise(head)
    m = m.withColumn("text_", text)
    swap = {"text": F.col("text_"), "n_chars": F.length("text_").cast("long")}
    return m.select(*[(swap[c] if c in swap else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
