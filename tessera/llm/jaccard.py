"""Near copies by SimHash with an exact check: the pipeline's setting of near-dedup.

A text is the set of its shingles of ``WIDTH`` words (lower-cased A-Z), with the SimHash fingerprint of that set.  Two
texts are near copies if their Jaccard similarity is at least ``THRESHOLD``.  At 0.8 the fingerprints differ in about
10 of 64 bits (standard deviation 3), so the radius is ``RADIUS``: a pair at 0.8 is outside it with a chance of some 1e-5.

First come the tables of ``llm.simhash``: fingerprints within three bits meet in ten tables keyed by two of five bit blocks, and their spanning
forest is confirmed.  No blocks of so few bits are selective at the wider radius.  The further buckets in which fingerprints are compared are
therefore keyed by the set itself: one of ``BANDS`` bands of ``ROWS`` minimum hashes, of which a pair of similarity s shares none with the
chance (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8 and less above.  Every pair within the radius is confirmed by its
shingles, so no pair below the threshold links.

Each bucket has a centre: the member that shares its buckets with most others, as the least edited of a family of
copies does.  A text is first compared with the most central of its buckets' centres, then with the other centres that are
not in its component yet.  Members of a bucket that are still in several components are compared with each other, in
pairs of chunks, bounded by rows and bytes: bit-sliced counters choose the pairs, the chunk's task confirms them and hands on a spanning forest.  Texts
travel to be confirmed, not pairs of sets: a centre's text goes once to each ``GUESTS`` of those compared with it.

Defined results.  Fewer words than the width make one shingle.  Texts with the same shingles are
copies, and so are all texts without words (null, empty, blank).  A null id is the smallest id.  Rows that repeat an id are
compared on their own.  Of centres that are alike central the one with the greatest key counts.  A very long text is hashed whole.  An empty table gives an empty result.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import components
from .common import drop, lift, materialize, slices, spread, whole
from .simhash import SEED, distances_over, links, slice_bits

WIDTH = 5
THRESHOLD = 0.8
RADIUS = 22
BANDS, ROWS = 24, 4
CHUNK = GUESTS = 256
#: Bytes of texts that a chunk of a bucket's members holds.
CHUNK_BYTES = 4 << 20
_PIECE = 2_048
_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = _rng.integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends[:-1]]
    width = min(width, len(words))
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.array([hash64(flat[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        np.minimum(least, ((hashes[at : at + _PIECE, None] ^ _FLIP) * _TIMES).min(0), out=least)
    return least


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set, as a signed number: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        counts += np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def bands(least: np.ndarray) -> np.ndarray:
    """One key a band; the band's number is mixed in."""
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _signed(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, banded, fps, sizes = [], [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text, width)
            keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            banded.append(bands(minima(own)))
            fps.append(fingerprint(own))
            sizes.append(len(text))
        columns = [batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(banded, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "version", "key", "bands", "fp", "bytes"])


def _compared(batches: Iterable[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Over (v, nth, key, text), sorted: a host's text (``nth`` 0) and then those to be compared with it."""
    host: tuple[int, np.ndarray] | None = None
    for batch in slices(batches):
        found = []
        for v, nth, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = shingles(text, width)
            if nth == 0:
                host = v, own
            elif host is None or host[0] != v:
                raise ValueError("a text to be compared came without its host")
            elif similarity(own, host[1]) >= threshold:
                found.append((key, v))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])


def _meet(batches: Iterable[pa.RecordBatch], width: int, threshold: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Over (band, a, b, own, key, root, fp, text), sorted: links between components within a pair of chunks."""
    at, rows = None, []
    for batch in slices(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:3] != at:
                yield from _forest(rows, width, threshold, radius)
                at, rows = row[:3], []
            rows.append(row[3:])
    yield from _forest(rows, width, threshold, radius)


def _forest(rows: list[tuple], width: int, threshold: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links between members ``(own, key, root, fp, text)`` of different components; those linked are compared no more."""
    own, keys, roots, fps, texts = zip(*rows, strict=True) if rows else [()] * 5
    parent = {r: r for r in roots}
    if len(parent) < 2:
        return

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    n, words = len(keys), -(-len(keys) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = np.array(fps, np.int64).view(np.uint64)
    planes, sets, found = slice_bits(padded), {}, []
    one_chunk = len(set(own)) == 1
    for first in range(0, n, 64):
        near = distances_over(planes[:, None, first // 64 :], padded[first : min(n, first + 64)][:, None], radius)
        for i, j in zip(*np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")), strict=True):
            i, j = int(i) + first, int(j) + first
            if not i < j < n or (own[i] == own[j] and not one_chunk) or (x := find(roots[i])) == (y := find(roots[j])):
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(texts[k], width)
            fewer, more = sorted((len(sets[i]), len(sets[j])))
            if fewer >= threshold * more and similarity(sets[i], sets[j]) >= threshold:
                parent[max(x, y)] = min(x, y)
                found.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])


def _with(f: Callable, *args) -> Callable:
    return lambda batches: f(batches, *args)


def confirmed(pairs: DataFrame, known: DataFrame, width: int, threshold: float) -> DataFrame:
    """The written pairs ``u, v`` of keys whose shingles are similar enough; ``known`` has a text of each key."""
    hosts = materialize(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / GUESTS).alias("parts")))
    guests = pairs.join(hosts, "v").select("v", F.pmod(F.xxhash64("u"), "parts").alias("part"), F.lit(1).alias("nth"), F.col("u").alias("key"))
    rooms = hosts.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("nth"), F.col("v").alias("key"))
    told = guests.union(rooms).join(known.hint("merge"), "key").select("v", "part", "nth", "key", "text")
    told = told.repartition("v", "part").sortWithinPartitions("v", "part", "nth").select("v", "nth", "key", "text")
    out = materialize(told.mapInArrow(_with(_compared, width, threshold), "u long, v long"))
    drop(hosts)
    return out


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose ends are in different components."""
    root = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
    for c in ("u", "v"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    return pairs.filter(root("u") != root("v")).select("u", "v")


def block_pairs(fps: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of keys, from ``key, fp``, that connect keys whose fingerprints are equal or within the radius of ``llm.simhash``."""
    heads = materialize(fps.groupBy("fp").agg(F.min("key").alias("v")))
    forest = materialize(links(heads.select("fp")))
    same = fps.select("key", "fp").join(heads, "fp").filter(F.col("key") != F.col("v")).select(F.col("key").alias("u"), "v")
    ends = forest.join(heads.toDF("u", "a"), "u").join(heads.toDF("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    out = materialize(same.union(ends).distinct())
    drop(heads, forest)
    return out


def rest_links(members: DataFrame, roots: DataFrame, known: DataFrame, width: int, threshold: float, radius: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far."""
    others = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "fp", "bytes", F.coalesce("root", "key").alias("root"))
    others = materialize(others)
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("bytes") / chunk_bytes)).cast("int")
    split = others.groupBy("band").agg(chunks.alias("chunks"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("band", "chunks")
    split = materialize(split)
    dealt = others.join(split, "band").withColumn("own", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    # each chunk meets each other chunk and itself; with one chunk that is the bucket
    dealt = dealt.select("band", "key", "root", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).join(known.hint("merge"), "key")
    dealt = dealt.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b", "key").select("band", "a", "b", "own", "key", "root", "fp", "text")
    out = materialize(dealt.mapInArrow(_with(_meet, width, threshold, radius), "u long, v long"))
    drop(others, split)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id, version, component``: the smallest id that links of at least the threshold reach from each row.

    ``version`` is a hash of the whole text, which tells rows with the same id apart.
    """
    text = whole(text_col)
    texts = docs.select(lift(id_col).alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    signed = materialize(spread(texts).mapInArrow(_with(_signed, width), "id long, version long, key long, bands array<long>, fp long, bytes long"))
    own = materialize(signed.select("id", "version", "key"))
    firsts = materialize(own.groupBy("key").agg(F.min(F.struct("id", "version")).alias("f")).select("key", "f.id", "f.version"))
    distinct = materialize(signed.join(firsts, ["key", "id", "version"]).dropDuplicates(["key"]).select("key", "bands", "fp", "bytes"))
    drop(signed)
    blocked = block_pairs(distinct)
    keyed = distinct.select("key", "fp", "bytes", F.explode("bands").alias("band"))
    shared = materialize(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = materialize(keyed.join(shared, "band"))
    drop(distinct, shared)
    weights = materialize(members.groupBy("key").agg(F.sum("n").alias("weight")))
    best = F.max(F.struct("weight", "key", "fp")).alias("c")
    centres = materialize(members.join(weights, "key").groupBy("band").agg(best).select("band", F.col("c.key").alias("v"), F.col("c.fp").alias("v_fp"), "c.weight"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("v_fp"))) <= radius
    near = materialize(members.join(centres, "band").filter(close & (F.col("key") != F.col("v"))).select(F.col("key").alias("u"), "v", "weight").distinct())
    # one text of each key in a bucket or a pair, moved once however few there are
    paired = blocked.select(F.explode(F.array("u", "v")).alias("key"))
    asked = weights.select("key").union(paired).distinct().join(firsts, "key").hint("merge")
    known = materialize(texts.join(asked, ["id", "version"]).groupBy("id", "version", "key").agg(F.first("text").alias("text")).select("key", "text"))
    linked = confirmed(blocked, known, width, threshold)
    first = components(linked)
    pairs = materialize(apart(near.groupBy("u").agg(F.max(F.struct("weight", "v")).alias("c")).select("u", "c.v"), first))
    direct = confirmed(pairs, known, width, threshold)
    roots = components(first.toDF("u", "v").union(direct))
    others = materialize(apart(near.select("u", "v"), roots).join(pairs, ["u", "v"], "left_anti"))
    more = confirmed(others, known, width, threshold)
    joined = components(roots.toDF("u", "v").union(more))
    rest = rest_links(members, joined, known, width, threshold, radius, chunk, chunk_bytes)
    ends = components(joined.toDF("u", "v").union(rest))
    rooted = materialize(firsts.join(ends.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root")))
    smallest = materialize(rooted.groupBy("root").agg(F.min("id").alias("component")))
    by_key = materialize(rooted.join(smallest, "root").select("key", "component"))
    drop(firsts, blocked, members, weights, centres, near, known, linked, first, pairs, others, direct, roots, more, joined, rest, ends, rooted, smallest)
    return own.join(by_key, "key").select("id", "version", "component")
