"""A corpus pipeline of five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of the
documents they got, extra ones included, whatever their names.

In every stage a null id is the smallest id, rows that repeat an id are documents of their own, a very long text is
one document that is read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, language_id, line_dedup, mixing, packing, simhash
from tessera.storage import drop, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go; ``lang`` is the predicted one.

    A text that is null, empty or has no letter has no language.  Where no row has a ``lang`` to learn from, none is
    told and all rows go.  Ties between languages are ambiguous.
    """
    return language_id.language_stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest id; ``n_chars`` follows the text.

    A null text stays null, with its ``n_chars``; an empty text has one empty line, which is too short to be dropped.
    """
    return line_dedup.line_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8 or more) stays: that with the smallest id.

    All texts without words (null, empty, blank) are copies of each other.  Rows that repeat both id and text are one
    document and stay or go together.
    """
    return simhash.simhash_stage(docs, jaccard.near_groups)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; documents may be repeated or left out.

    A null source is a source of its own; documents without words are left out.  The document at a source's cut
    ends after the last word taken.
    """
    return mixing.mix_stage(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into token sequences; a null text is empty and has the closing token alone."""
    return packing.packing_report(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("sequences", sequences)]

#: The first stage is a trained model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again; a table goes when the next is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return docs
