"""WARC records in seekable Zstandard bundles.

A bundle is a Zstandard file: records are grouped into frames that can be decompressed on
their own, and the last, skippable frame is the seek table of the Zstandard
seekable format (compressed and decompressed size of each frame).  A record's address is
``(bundle, frame, offset in the decompressed frame)``, so one record is read by
decompressing one frame.

Bundles travel as a table (``bundle_id, data, entries``) in the shared folder, since
executors share no local disk; ``export_bundles`` writes them as files.  A payload of at
least ``min_revisit`` bytes that several records have is stored once: in the record with the
smallest id; the others are ``revisit`` records that name it.

Defined results.  A null html is an empty payload; a null url is the empty url; a null id
is the smallest id.  Records that repeat the id of the response with its payload are
responses as well; other ties do not arise.  A very long payload is a record, and a frame, of its own.  An empty
table gives no bundles.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, materialize, slices, whole

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
_BUNDLE = "bundle_id string, data binary, entries array<struct<id:long,frame:int,offset:long,length:long>>"
_BUNDLE_ARROW = pa.schema([
    ("bundle_id", pa.string()), ("data", pa.binary()),
    ("entries", pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
])
_READ = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle_id string, frame int, offset long"
_READ_ARROW = pa.schema([
    ("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("bundle_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()),
])


def write_record(ident: int, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    block = HTTP_HEAD % len(payload)
    if refers is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(frame: bytes, offset: int) -> dict:
    """The record at ``offset``: headers, payload, and the id, kind and digest from them."""
    end = frame.index(b"\r\n\r\n", offset)
    lines = frame[offset:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = frame[end + 4 : end + 4 + int(headers["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    of = lambda name: int(headers[name][len("<urn:page:") : -1])
    out = {"id": of("WARC-Record-ID"), "type": headers["WARC-Type"], "headers": headers, "payload": payload, "refers": None}
    if out["type"] == "revisit":
        return out | {"refers": of("WARC-Refers-To"), "bytes": int(headers["X-Payload-Length"]), "digest": headers["WARC-Payload-Digest"][7:]}
    return out | {"bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, decompressed) size of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    out, at = [], 0
    for k in range(n):
        size, full = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - k))
        out.append((at, size, full))
        at += size
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, size, full = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=max(1, full)) if full else b""


class Bundler:
    """Collects records into frames and bundles; holds one bundle at a time."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._clear()

    def _clear(self) -> None:
        self._data, self._sizes, self._entries, self._open = bytearray(), [], [], bytearray()

    def add(self, ident: int, record: bytes) -> dict | None:
        """Add a record; a finished bundle, if it is full."""
        self._entries.append({"id": ident, "frame": len(self._sizes), "offset": len(self._open), "length": len(record)})
        self._open += record
        if len(self._open) >= self.frame_bytes:
            self._end_frame()
        return self.finish() if len(self._data) >= self.bundle_bytes else None

    def _end_frame(self) -> None:
        if self._open:
            packed = self._zstd.compress(bytes(self._open))
            self._sizes.append((len(packed), len(self._open)))
            self._data += packed
            self._open = bytearray()

    def finish(self) -> dict | None:
        self._end_frame()
        if not self._entries:
            return None
        data = bytes(self._data) + seek_table(self._sizes)
        out = {"bundle_id": hashlib.sha256(data).hexdigest()[:32], "data": data, "entries": self._entries}
        self._clear()
        return out


def _bundles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, bundler = _BUNDLE_ARROW, Bundler()
    give = lambda b: pa.RecordBatch.from_pylist([b], schema=schema)
    for batch in slices(batches):
        for ident, url, payload, digest, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if done := bundler.add(ident, write_record(ident, url, payload, digest, refers)):
                yield give(done)
    if done := bundler.finish():
        yield give(done)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _READ_ARROW
    for batch in slices(batches, 1):  # a bundle is some MB
        for bundle_id, data, entries in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            frames, at, frame, rows = read_seek_table(data), -1, b"", []
            for e in entries:
                if e["frame"] != at:
                    at, frame = e["frame"], read_frame(data, frames[e["frame"]])
                r = read_record(frame, e["offset"])
                if r["id"] != e["id"]:
                    raise ValueError(f"bundle {bundle_id}: record {r['id']} where the index has {e['id']}")
                rows.append((r["id"], r["bytes"], r["digest"], r["type"], r["refers"], bundle_id, e["frame"], e["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """``id, url, payload, digest, refers``: what each page's record holds."""
    p = pages.select(lift("page_id").alias("id"), whole("url").alias("url"), whole("html").cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    twice = materialize(
        p.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1").drop("n")
    )
    refers = F.when(F.col("first") != F.col("id"), F.col("first"))
    return p.join(twice, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers"))


def write_bundles(pages: DataFrame) -> DataFrame:
    """The written bundles: ``bundle_id, data, entries``."""
    return materialize(records(pages).mapInArrow(_bundles, _BUNDLE))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record, read back by its address in its bundle."""
    return bundles.mapInArrow(_records, _READ)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<bundle_id>.warc.zst`` to a folder that all executors mount.

    Names follow from content and files appear by renaming, so a repeated task does no harm.
    """

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = batch.column("bundle_id").to_pylist()
            for name, data in zip(names, batch.column("data").to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, f"{name}.warc.zst"))
            yield pa.RecordBatch.from_pydict({"file": [f"{n}.warc.zst" for n in names]})

    return bundles.select("bundle_id", "data").mapInArrow(save, "file string")


def warc_report(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read from the archives."""
    r = read_bundles(write_bundles(pages))
    return r.select(
        give_back(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        give_back(F.col("refers_to")).alias("refers_to"), "bundle_id", "frame", "offset",
    )


def warc_report_digest(pages: DataFrame) -> DataFrame:
    """:func:`warc_report` without the addresses, which depend on how rows were dealt."""
    return warc_report(pages).drop("bundle_id", "frame", "offset")
