"""Sources of files, vectors and logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from .matrix import fp16_matrix  # noqa: F401


def scan(spark: SparkSession, folder: str, suffixes: list[str] | None = None, skip: str | None = None) -> DataFrame:
    """``filename, mtime, size`` of all files below a folder; ``mtime`` in microseconds.

    Names are relative to the folder.  Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    name = F.substring_index(F.col("path"), root.removeprefix("file:").lstrip("/"), -1)
    out = files.select(name.alias("filename"), F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))
    if suffixes:
        out = out.filter(F.lower(F.element_at(F.split("filename", r"\."), -1)).isin(suffixes))
    return out.filter(~F.col("filename").startswith(skip)) if skip else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newer_inputs(spark: SparkSession, folder: str, after: str, schema: StructType | str) -> DataFrame:
    """JSON lines of the files whose name sorts after ``after``, with ``file``."""
    lines = spark.read.schema(schema).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return lines.filter(F.col("file") > after)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Steps of a training log; its first line, the configuration, has no step."""
    return spark.read.schema(schemas.TRAINING_LOG).json(path).filter("step IS NOT NULL")


def sample_records(spark: SparkSession, path: str) -> DataFrame:
    """Processed entries as JSON lines, the last per URL."""
    from ..operators.incremental import last_by

    return last_by(spark.read.schema(schemas.PROCESSED_ENTRY).json(path), ["url"], "timestamp")


def scraped(html: Column, pattern: str, *names: str) -> Column:
    """All matches of a pattern as an array of structs with the groups' texts."""
    groups = [F.regexp_extract_all(html, F.lit(pattern), k + 1).alias(n) for k, n in enumerate(names)]
    return F.arrays_zip(*groups)


def load_arrays(path: str) -> dict[str, np.ndarray]:
    """Arrays of a trained artefact (.npz)."""
    with np.load(path) as f:
        return {k: f[k] for k in f.files}
