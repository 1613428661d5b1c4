"""What the operators of this package share: ids, texts, batches, ranks.

Ids.  A null id is read as the smallest possible id (``MIN_ID``), so that every
row keeps a place in joins, groups and orders; results give it back as null.  A genuine id
of ``MIN_ID`` is not told from null.

Texts of any length are whole values of one row.  Arrow batches are bounded in bytes by
Spark (``spark.sql.execution.arrow.maxBytesPerBatch``), and :func:`slices` bounds the rows that a Python
function holds as objects; no setting of the session is changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, materialize

MIN_ID = -(2**63)
#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def lift(name: str) -> Column:
    """The id column, with null as the smallest id."""
    return F.coalesce(F.col(name).cast("long"), F.lit(MIN_ID))


def give_back(c: Column) -> Column:
    """The inverse of :func:`lift`."""
    return F.when(c != F.lit(MIN_ID), c)


def whole(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def word_count(c: Column) -> Column:
    """Number of matches of [^\\x20\\x09-\\x0D]+ in a text that isn't null."""
    inner = strip_blanks(c)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a string that are seeded differently."""
    return F.xxhash64(c), F.xxhash64(F.lit("second half"), c)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows.

    Before the next batch is read, what Arrow has freed goes back to the system: a worker is kept from task to task, and
    Arrow's pool would hold several batches in it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
        pa.default_memory_pool().release_unused()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table in one row group would otherwise be one task of a costly function; a table
    that is split well enough is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranked(df: DataFrame, group: list[str], spread: Column, order: list[Column], rows: int, groups: int, block_rows: int = 20_000) -> DataFrame:
    """Add ``rank``: gapless from 0 within each group of a written table, without one task a group.

    Rows of a group are dealt over blocks by the hash ``spread``; a rank is the
    number of rows in earlier blocks, from one count per block, plus the place
    within the block.  ``rows`` and ``groups`` set the number of blocks, so that
    a block has about ``block_rows`` rows at any size.  Rows that repeat share a hash; a block
    that they fill beyond four times its share is dealt on by the rows' places in the table.
    """
    blocks = max(1, -(-rows // max(1, groups) // block_rows))
    dealt = df.withColumns({"_block": F.pmod(spread, F.lit(blocks)).cast("int"), "_sub": F.lit(0)})
    large = materialize(
        dealt.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 4 * block_rows)
        .select(*group, "_block", F.ceil(F.col("_n") / block_rows).alias("_parts"))
    )
    if not large.isEmpty():
        numbered = dealt.drop("_sub").withColumn("_row", F.monotonically_increasing_id()).join(large, [*group, "_block"], "left")
        sub = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0)).cast("int")
        dealt = materialize(numbered.withColumn("_sub", sub).drop("_row", "_parts"))
    before = Window.partitionBy(*group).orderBy("_block", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy(*group, "_block", "_sub")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*group, "_block", "_sub").orderBy(*order)
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(counts, [*group, "_block", "_sub"])
        .withColumn("rank", (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_block", "_sub", "_at", "_before")
    )
