"""Flat half-precision matrices as a Spark data source: ``spark.read.format("fp16_matrix").option("dims", n).load(path)``.

Gives ``file, row, embedding`` of a file, or of all files of a folder (local, or a URI of a store that Arrow knows).  A file is dealt into
ranges of ``split_rows`` rows (an option), each read by a task of its own from its place in the file, so that no task holds a file.  A broken last
row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .zstd_lines import opened

SPLIT_ROWS = 100_000
_BATCH = 10_000


@dataclass
class _Rows(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dims = options["path"], int(options["dims"])
        self.split = int(options.get("split_rows", SPLIT_ROWS))

    def partitions(self) -> list[InputPartition]:
        fs, at = opened(self.path)
        info = fs.get_file_info(at)
        if info.type == store.FileType.NotFound:
            raise FileNotFoundError(self.path)
        hidden = lambda f: f.base_name.startswith(("_", "."))
        found = [info] if info.is_file else sorted((f for f in fs.get_file_info(store.FileSelector(at)) if f.is_file and not hidden(f)), key=lambda f: f.path)
        name = lambda f: self.path if info.is_file else f"{self.path.rstrip('/')}/{f.base_name}"
        rows = lambda f: f.size // (2 * self.dims)
        return [_Rows(name(f), at, min(rows(f), at + self.split)) for f in found for at in range(0, rows(f), self.split)]

    def read(self, partition: _Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a row
            return
        fs, path = opened(partition.path)
        with fs.open_input_file(path) as file:
            for at in range(partition.first, partition.last, _BATCH):
                n = min(_BATCH, partition.last - at)
                file.seek(at * self.dims * 2)
                x = np.frombuffer(file.read(n * self.dims * 2), "<f2").astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dims + 1, self.dims), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(at, at + n)), lists], ["file", "row", "embedding"])


class Fp16Matrix(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "fp16_matrix"

    def schema(self) -> str:
        return "file string, row long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fp16_matrix(spark: SparkSession, path: str, dims: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``file, row, embedding`` of flat half-precision matrices."""
    spark.dataSource.register(Fp16Matrix)
    return spark.read.format("fp16_matrix").option("dims", dims).option("split_rows", split_rows).load(path)
