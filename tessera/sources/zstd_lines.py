"""Lines of Zstandard files with windows of up to 2^31 bytes, which Spark's own reader refuses.

``spark.read.format("zstd_lines").load(path)`` gives ``value, path`` of the file, or of all ``.zst`` files of the folder, that ``path``
names (local, or a URI of a store that Arrow knows).  Only names and sizes are listed on the driver.  A file is dealt into
ranges of ``split_bytes`` (an option); the task of a range decodes the frames that begin in it, which it finds by
walking over block headers, so that a file of many frames is read by many tasks.  A line belongs to the frame in which it begins, however many it
goes on through: a task ends its last line in later frames, and skips to the first line break unless it begins the file.

Where a file is cut off within a frame, all whole lines before the cut are given, and what follows the last line break is not; in a
whole file the last line needs no line break.  Empty lines are lines.  Bytes that aren't UTF-8 are replaced.  A decoder needs memory for one
window, as the file says, at most 2^``window_log`` bytes (an option, 31).
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs as store
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 128 << 20
ROWS, BYTES = 10_000, 4 << 20
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)


def opened(path: str) -> tuple[store.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return store.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else path)
    return store.LocalFileSystem(), path


@dataclass(frozen=True)
class Frame:
    """A frame's place in its file; ``whole`` is false where the file ends within it, ``data`` for frames to skip."""

    start: int
    end: int
    whole: bool
    data: bool


def _block(head: bytes) -> tuple[bool, int]:
    """Whether a block is its frame's last, and the length of its content."""
    block = int.from_bytes(head, "little")
    return bool(block & 1), 1 if block >> 1 & 3 == 1 else block >> 3


def frames(file: pa.NativeFile, size: int) -> Iterator[Frame]:
    """The frames of a file in order, by their headers and those of their blocks."""
    at = 0
    while at < size:
        file.seek(at)
        head = file.read(18)
        if len(head) >= 8 and int.from_bytes(head[:4], "little") in _SKIPPABLE:
            end = at + 8 + int.from_bytes(head[4:8], "little")
            yield Frame(at, min(end, size), end <= size, False)
        else:
            try:
                end, last = at + zstandard.frame_header_size(head), False
                checksum = 4 * zstandard.get_frame_parameters(head).has_checksum
            except zstandard.ZstdError:
                if size - at < 18:  # cut off within the header
                    return
                raise
            while not last and end + 3 <= size:
                file.seek(end)
                last, length = _block(file.read(3))
                end += 3 + length
            end += checksum
            yield Frame(at, min(end, size), last and end <= size, True)
        at = end


def _decoded(file: pa.NativeFile, frame: Frame, window_log: int) -> Iterator[bytes]:
    """A frame's content as far as it goes, a block (of 128 KiB at most) at a time."""
    file.seek(frame.start)
    head = file.read(18)
    at = frame.start + zstandard.frame_header_size(head)
    decoder = zstandard.ZstdDecompressor(max_window_size=1 << window_log).decompressobj()
    part, last = head[: at - frame.start], False
    while True:
        if out := decoder.decompress(part):
            yield out
        file.seek(at)
        if last or at + 3 > frame.end:
            return
        head = file.read(3)
        last, length = _block(head)
        part = head + file.read(min(length, frame.end - at - 3))
        at += 3 + length


def lines(chunks: Iterable[tuple[bool, bytes]], first: bool, whole: Callable[[], bool]) -> Iterator[bytes]:
    """Lines that begin in own chunks ``(own, bytes)``; the last may end in chunks that follow.

    Unless the chunks are the ``first`` of a file, what precedes their first line break is another's.  What has no line break at
    the file's end is a line if ``whole()`` then says that the file isn't cut off.
    """
    open_line: list[bytes] | None = [] if first else None
    for own, chunk in chunks:
        *done, rest = chunk.split(b"\n") if own else chunk.split(b"\n", 1)
        if open_line is None and not own:
            return
        for k, piece in enumerate(done):
            if open_line is not None:
                yield b"".join((*open_line, piece)) if open_line else piece
            open_line = []
            if not own and k == 0:
                return
        if open_line is not None and rest:
            open_line.append(rest)
    if open_line and whole():
        yield b"".join(open_line)


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.window_log = int(options.get("window_log", 31))

    def partitions(self) -> list[InputPartition]:
        fs, at = opened(self.path)
        info = fs.get_file_info(at)
        if info.type == store.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else sorted((f for f in fs.get_file_info(store.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".zst")), key=lambda f: f.path)
        base = self.path.rstrip("/")
        return [
            _Range(self.path if info.is_file else base + f.path[len(info.path.rstrip("/")) :], lo, min(f.size, lo + self.split), f.size)
            for f in found for lo in range(0, f.size, self.split)
        ]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a byte
            return
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as file:
            found = [f for f in frames(file, partition.size) if f.data]
            own = [f for f in found if partition.lo <= f.start < partition.hi]
            if not own:
                return
            state = {"whole": True}

            def chunks() -> Iterator[tuple[bool, bytes]]:
                for f in found[found.index(own[0]) :]:
                    for out in _decoded(file, f, self.window_log):
                        yield f.start < partition.hi, out
                    state["whole"] = f.whole

            batch, held = [], 0
            for line in lines(chunks(), own[0] is found[0], lambda: state["whole"]):
                batch.append(line.decode("utf-8", "replace"))
                held += len(line)
                if len(batch) >= ROWS or held >= BYTES:
                    yield self._rows(batch, partition.path)
                    batch, held = [], 0
            if batch:
                yield self._rows(batch, partition.path)

    @staticmethod
    def _rows(batch: list[str], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(batch, pa.string()), pa.array([path] * len(batch), pa.string())], ["value", "path"])


class ZstdLines(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "zstd_lines"

    def schema(self) -> str:
        return "value string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_zstd_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, window_log: int = 31) -> DataFrame:
    """``value, path`` of each line."""
    spark.dataSource.register(ZstdLines)
    return spark.read.format("zstd_lines").option("split_bytes", split_bytes).option("window_log", window_log).load(path)


def write_zstd_lines(df: DataFrame, folder: str, window_log: int = 27, frame_rows: int = 100_000, value: str = "value", broken_end: int = 0) -> DataFrame:
    """Write a file a partition, in frames of ``frame_rows`` lines, and return ``path, lines`` of each.

    The result must be used, as it does the writing.  A file gets its name when it is whole, so an attempt that fails leaves none.  With
    ``broken_end`` the first file ends within a further line of so many bytes, as a copy that broke off does.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, at = opened(folder)
        fs.create_dir(at, recursive=True)
        name, draft = f"{at}/part-{number:05d}.zst", f"{at}/_{uuid.uuid4().hex}"
        options = zstandard.ZstdCompressionParameters.from_level(3, window_log=window_log)
        compressor, count, left, stream = zstandard.ZstdCompressor(compression_params=options), 0, frame_rows, None
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    stream = stream or compressor.compressobj()
                    out.write(stream.compress(line.encode() + b"\n"))
                    count, left = count + 1, left - 1
                    if not left:
                        out.write(stream.flush())
                        left, stream = frame_rows, None
            if broken_end and number == 0:
                stream = stream or compressor.compressobj()
                rest = stream.compress(random.Random(0).randbytes(broken_end).hex().encode()) + stream.flush()
                out.write(rest[: -broken_end // 4])
            elif stream:
                out.write(stream.flush())
        fs.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/part-{number:05d}.zst"]), pa.array([count], pa.int64())], ["path", "lines"])

    return df.select(value).mapInArrow(write, "path string, lines long")
