"""Vector functions on array columns, and their numpy twins for Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, accumulated in double in the order of dimensions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column | str, w: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * w)


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def normalised(a: Column | str) -> Column:
    """The unit vector; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sign_code(a: Column | str) -> Column:
    """A character per dimension: 1 where the value is above zero."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def by_dimension(df: DataFrame, *keep: str, vector: str = "embedding") -> DataFrame:
    """A row per vector and dimension: ``keep, pos, x``."""
    return df.select(*keep, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def gathered(dims: DataFrame, *keys: str, value: str = "x", to: str = "vector") -> DataFrame:
    """The inverse of :func:`by_dimension`: arrays in the order of ``pos``."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return dims.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(to))


def mean_vectors(df: DataFrame, *keys: str, vector: str = "embedding", to: str = "centroid") -> DataFrame:
    """The mean vector of each group; partial sums per dimension are combined before the shuffle."""
    dims = by_dimension(df, *keys, vector=vector).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return gathered(dims, *keys, to=to)


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix of doubles, without a Python object per value.

    A null vector, a null value or vectors of several lengths are an error, never a shift of values.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count or column.flatten().null_count:
        raise ValueError("a vector is null or has a null value")
    if n and len(set(np.unique(column.value_lengths().to_numpy(zero_copy_only=False)))) > 1:
        raise ValueError("vectors have several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)


def over_rows(f: Callable[[np.ndarray], np.ndarray], kind: str) -> Callable[..., Column]:
    """A column function that applies ``f`` to the matrix of a batch's vectors; a null vector gives null."""

    @F.pandas_udf(kind)
    def apply(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = pd.Series([None] * len(x), dtype=object)
        if known.any():
            values = f(np.stack(x[known].to_numpy()).astype(np.float64))
            out[known] = pd.Series(list(values), index=out.index[known], dtype=object)
        return out

    return apply


@F.pandas_udf(BinaryType())
def fp16_encode(vectors: pd.Series) -> pd.Series:
    """Little-endian half-precision bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def fp16_decode(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))


def query_vector(text: str) -> np.ndarray:
    """A URL-safe base64 half-precision query vector, padded or not."""
    return np.frombuffer(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)), "<f2").astype(np.float32)


def base64url_bytes(c: Column | str) -> Column:
    """The bytes of URL-safe base64 text."""
    return F.unbase64(F.translate(c, "-_", "+/"))
