"""The encoder interface: texts or images in, unit vectors out, in bounded batches.

No model ships with the engine.  An encoder is any picklable callable that takes a list of inputs and
returns a matrix; where a term needs one and none is given, that is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Encoder = Callable[[list], np.ndarray]


def encoded(df: DataFrame, encoder: Encoder, key: str, value: str, max_batch: int = 128, unit: bool = True) -> DataFrame:
    """``key, embedding``: batches of at most ``max_batch``, to unit length if ``unit``; null inputs give null vectors."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), max_batch):
                part = frame.iloc[at : at + max_batch]
                there = part[value].notna().to_numpy()
                vectors: list = [None] * len(part)
                if there.any():
                    x = np.asarray(encoder(part[value][there].tolist()), np.float64)
                    if unit:
                        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    for k, row in zip(np.flatnonzero(there), x, strict=True):
                        vectors[k] = row.tolist()
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": pd.Series(vectors, dtype=object)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, value).mapInPandas(run, f"{key} {kind}, embedding array<float>")
