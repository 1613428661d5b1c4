"""SimHash near-dedup by bit-sliced comparison.

Texts are lower-cased (A-Z), split into words and shingled (``width`` words); a
fingerprint bit is 1 if it is set in over half of the shingles' XXH64 hashes.  Two
fingerprints within ``RADIUS`` bits agree in at least two of five bit blocks, so every
link is found in one of ten tables keyed by two blocks.  Only distinct fingerprints
meet there, however many documents share one.

Within a bucket fingerprints are stored as 64 vertical bit planes, 64 fingerprints a word.
Distances of a query to all of them grow in carry-save counters (of two bits for a radius of 3) and an
overflow bit per fingerprint; once all of a block's fingerprints have overflowed,
the block is abandoned.  A bucket emits a spanning forest of its links, not its
pairs.  Buckets above ``CHUNK`` fingerprints are dealt as pairs of chunks, so that a task
holds at most two chunks and still each pair is compared.

Components: alternating large-star and small-star rounds over the links, each
written to the shared folder, until nothing changes (``operators.links``).

Defined results.  A null or empty text has no words: fingerprint zero.  Fewer words than
the width make one shingle.  A null id is the smallest id.  Rows that repeat an id are
fingerprinted on their own; the stage keeps equal rows or drops them together.  A bit that is set in exactly half of the
shingles is 0.  A very long text is hashed whole, in parts of bounded size.  An empty table gives an empty result.
Other columns are ignored, whatever their names; the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import components
from .common import drop, give_back, lift, materialize, slices, spread, whole

RADIUS = 3
SEED = 42
CHUNK = 16_384
BLOCKS = (13, 13, 13, 13, 12)
_PIECE = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text in UTF-8, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[:-1]]
    width = min(width, len(words))
    hash64 = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        last = min(n, at + _PIECE)
        h = [hash64(flat[a : b - 1], SEED) for a, b in zip(starts[at:last], ends[at + width - 1 : last + width - 1], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "version", "fp"])


def distances_over(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bit-sliced comparison: words whose bits tell which fingerprints are within the radius.

    ``planes`` is (64, ..., words); ``queries`` broadcasts against ``planes[0]``.  Counters start where
    the first difference beyond the radius overflows them.
    """
    one = np.uint64(1)
    shape = np.broadcast_shapes(planes.shape[1:], queries.shape)
    width = radius.bit_length()
    first = (1 << width) - 1 - radius
    counters = [np.full(shape, _ALL if first >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros(shape, np.uint64)
    for b in range(64):
        carry = planes[b] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & one))
        for counter in counters:
            up = counter & carry
            counter ^= carry
            carry = up
        over |= carry
        if b % 16 == 15 and (over == _ALL).all():
            break
    return ~over


def slice_bits(fps: np.ndarray) -> np.ndarray:
    """(64, words) planes of fingerprints (..., 64 * words); bit k of word w is fingerprint 64 w + k."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(*fps.shape, 8), axis=-1, bitorder="little")
    bits = np.moveaxis(bits, -1, 0)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def _small(buckets: list[np.ndarray]) -> tuple[list, list]:
    """Spanning forests of buckets of up to 64 fingerprints, compared all at once."""
    most = max(map(len, buckets))
    sizes = np.array([len(b) for b in buckets])
    padded = np.zeros((len(buckets), 64), np.uint64)
    for k, b in enumerate(buckets):
        padded[k, : len(b)] = b
    planes = slice_bits(padded)[..., 0]
    valid = np.where(sizes == 64, _ALL, (np.uint64(1) << sizes.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    near = np.stack([distances_over(planes, padded[:, s]) & valid for s in range(most)], 1)
    near[np.arange(most)[None, :] >= sizes[:, None]] = 0
    linked = (near & ~(np.uint64(1) << np.arange(most, dtype=np.uint64)[None, :])).any(1)
    src, dst = [], []
    for k in np.flatnonzero(linked):
        masks, alive = near[k].tolist(), (1 << int(sizes[k])) - 1
        while alive:
            root = (alive & -alive).bit_length() - 1
            alive &= ~(1 << root)
            todo = [root]
            while todo:
                found = masks[todo.pop()] & alive
                alive &= ~found
                while found:
                    at = (found & -found).bit_length() - 1
                    found &= found - 1
                    todo.append(at)
                    src.append(int(buckets[k][at]))
                    dst.append(int(buckets[k][root]))
    return src, dst


def _large(fps: np.ndarray, batch: int = 64) -> tuple[list, list]:
    """Spanning forest of one bucket; a fingerprint that is reached is not looked for again."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    planes = slice_bits(padded)
    alive = np.packbits(np.arange(words * 64) < len(fps), bitorder="little").view("<u8").copy()
    src, dst = [], []
    at = 0
    while at < len(fps):
        if not (int(alive[at // 64]) >> (at % 64)) & 1:
            at += 1
            continue
        root, todo = fps[at], [at]
        alive[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        while todo and alive.any():
            ask, todo = todo[:batch], todo[batch:]
            live = np.flatnonzero(alive)
            near = np.bitwise_or.reduce(distances_over(planes[:, None, live], padded[ask][:, None]), 0) & alive[live]
            hit = np.unpackbits(near.view(np.uint8), bitorder="little").reshape(-1, 64)
            alive[live] &= ~near
            w, k = np.nonzero(hit)
            found = live[w] * 64 + k
            todo.extend(found.tolist())
            src.extend(padded[found].tolist())
            dst.extend([int(root)] * len(found))
    return src, dst


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(0)
        flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(column.offsets.to_numpy()))
        buckets = np.split(flat, ends[:-1])
        small = [b for b in buckets if len(b) <= 64]
        for src, dst in ([_small(small)] if small else []) + [_large(b) for b in buckets if len(b) > 64]:
            ends_of = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)]
            yield pa.RecordBatch.from_arrays(ends_of, schema=schema)


def links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links ``u, v`` that connect distinct fingerprints ``fp`` within the radius."""
    cuts = [0, *accumulate(BLOCKS)]
    value = lambda b: F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << BLOCKS[b]) - 1))
    tables = [F.struct(F.lit(t).alias("t"), (F.shiftleft(value(i), 13).bitwiseOR(value(j))).alias("key")) for t, (i, j) in enumerate(combinations(range(5), 2))]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.key")
    shared = materialize(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    dealt = keyed.join(shared, ["t", "key"]).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    # each chunk meets each other chunk and itself; with one chunk that is the bucket
    dealt = dealt.select("fp", "t", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    buckets = dealt.groupBy("t", "key", "a", "b").agg(F.collect_list("fp").alias("fps")).select("fps")
    return buckets.mapInArrow(_links, "u long, v long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, version, fp, component``: the smallest id that links reach from each row.

    ``version`` is a hash of the whole text, which tells rows with the same id apart.
    """
    text = whole(text_col)
    texts = docs.select(lift(id_col).alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    own = materialize(spread(texts).mapInArrow(_fingerprints, "id long, version long, fp long"))
    distinct = materialize(own.groupBy("fp").agg(F.min("id").alias("first")))
    near = materialize(links(distinct.select("fp")))
    roots = components(near)
    rooted = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component")))
    by_fp = materialize(rooted.join(smallest, "root").select("fp", "component"))
    drop(distinct, near, rooted, smallest)
    return own.join(by_fp, "fp").select("id", "version", "fp", "component")


def simhash_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each document."""
    g = near_groups(docs)
    return g.select(
        give_back(F.col("id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        give_back(F.col("component")).alias("component_id"),
    )


def simhash_stage(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_groups) -> DataFrame:
    """The documents whose id is the smallest of their component in ``groups``."""
    drop = groups(docs).filter("id != component").select("id", "version").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(row, lift("doc_id").alias("id"), F.xxhash64(whole("text")).alias("version"))
    # ids are in proportion to the documents, so they are never sent to all tasks
    return rows.join(drop.hint("merge"), ["id", "version"], "left_anti").select("doc.*")
