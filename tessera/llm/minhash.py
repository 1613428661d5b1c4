"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, with an exact check.

A text is the set of its shingles of ``WIDTH`` words (lower-cased A-Z).  Its signature has ``CHUNKS * ROWS`` symbols of ``BITS`` bits: the
low bits of the least value of the set under as many hash functions, so that two sets of similarity s differ in each symbol with a
chance of 1 - s.  The signature distance is the number of symbols that differ.  ``DISTANCE`` is chosen so that a pair at ``THRESHOLD`` is beyond
it with a chance below 1e-4 (see :func:`beyond`; less above the threshold).

Join.  Signatures are split into ``CHUNKS`` chunks.  By the pigeonhole principle two signatures within
``CHUNKS * (ERRORS + 1) - 1`` differ in at most ``ERRORS`` symbols of some chunk.  All allowed errors of a chunk are enumerated: each
choice of ``ERRORS`` places is left out, and what remains, with chunk and choice, is a key.  Two chunks share a key exactly if they
differ in no other places, so every pair within the distance shares a bucket, and no pair is looked for elsewhere.

Links.  Each bucket has a centre: the member that shares its buckets with most others.  A text is first compared with the most central of its
centres, then with its other centres that are not yet in its component.  Members of a bucket that are still in several components
meet by their signatures, in pairs of large chunks; those that have a candidate in another component meet again in pairs of chunks that are bounded by
rows and bytes, whose tasks confirm by the sets and hand on a spanning forest.  A pair that shares many buckets is a candidate only in the first.  All links
are confirmed by the full sets; only texts with different sets take part, each once, however many documents have it.

Defined results.  Fewer words than the width make one shingle.  A text without words (null, empty, blank) has no
shingle and is linked with nothing, not even its equals.  Texts with the same shingles are linked.  A null id is the smallest id.  Rows that repeat an
id are compared on their own; a component is named by the smallest id in it.  A very long text is hashed whole, in parts of bounded size.  An empty
table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.links import components
from .common import drop, give_back, lift, materialize, slices, spread, whole
from .jaccard import apart, confirmed, shingles
from .simhash import SEED

WIDTH = 4
THRESHOLD = 0.8
BITS = 16
CHUNKS, ROWS, ERRORS = 10, 4, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Rows and bytes of texts of one chunk of a bucket's members.
CHUNK, CHUNK_BYTES = 256, 4 << 20
_PIECE = 2_048
_rng = np.random.default_rng(SEED)
_FLIP, _TIMES = _rng.integers(0, 2**64, (2, CHUNKS * ROWS), np.uint64)
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def beyond(similarity: float, symbols: int = CHUNKS * ROWS, distance: int = DISTANCE) -> float:
    """The chance that the signatures of two sets of a similarity differ in more symbols than the distance."""
    return sum(comb(symbols, k) * (1 - similarity) ** k * similarity ** (symbols - k) for k in range(distance + 1, symbols + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The b-bit symbols of a set that isn't empty."""
    least = np.full(CHUNKS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        x = (hashes[at : at + _PIECE, None] ^ _FLIP) * _TIMES
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    # least values are small, so their bits are mixed before some are taken
    return ((least * _MIX) >> np.uint64(64 - BITS)).astype(np.uint16)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of all chunks of a signature with every choice of ``ERRORS`` places left out."""
    parts = symbols.reshape(CHUNKS, ROWS).astype(np.uint64)
    keys = []
    for n, kept in enumerate(combinations(range(ROWS), ROWS - ERRORS)):
        key = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(comb(ROWS, ERRORS)) + np.uint64(n)
        for place in kept:
            key = (key ^ parts[:, place]) * _MIX
            key ^= key >> np.uint64(29)
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, version, n, key, sig, keys, bytes`` of (id, version, text); the last four are null for a text without words."""
    for batch in slices(batches):
        n, keys, signatures, banded, sizes = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text, WIDTH)
            n.append(len(own))
            found = signature(own) if len(own) else None
            keys.append(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else None)
            signatures.append(found.tobytes() if len(own) else None)
            banded.append(chunk_keys(found) if len(own) else None)
            sizes.append(len(text))
        columns = [pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(signatures, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "version", "n", "key", "sig", "keys", "bytes"])


def first_slots(matches: np.ndarray) -> np.ndarray:
    """Of rows (..., symbols) of matching symbols: the place among :func:`chunk_keys` of the first key that both signatures have; -1 without one."""
    differ = ~matches.reshape(*matches.shape[:-1], CHUNKS, ROWS)
    slots = []
    for kept in combinations(range(ROWS), ROWS - ERRORS):
        slots.append(~differ[..., list(kept)].any(-1))
    shared = np.concatenate(slots, -1)
    return np.where(shared.any(-1), shared.argmax(-1), -1)


def _candidates(slot: int, n: np.ndarray, roots: np.ndarray, symbols: np.ndarray, i: int) -> np.ndarray:
    """Members after the ``i``-th that may be similar to it, are in another component, and share no earlier bucket with it: a pair is confirmed in one bucket."""
    rest = slice(i + 1, None)
    likely = (np.minimum(n[rest], n[i]) >= THRESHOLD * np.maximum(n[rest], n[i])) & (roots[rest] != roots[i])
    at = np.flatnonzero(likely)
    matches = symbols[at + i + 1] == symbols[i]
    near = matches.shape[1] - matches.sum(1) <= DISTANCE
    at = at[near]
    return at[first_slots(matches[near]) == slot] + i + 1


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first ``keys`` columns, a group at a time."""
    at, rows = None, []
    for batch in slices(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _signatures(found: Iterable[bytes], rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(found), np.uint16).reshape(rows, -1)


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (bucket, slot, a, b, own, key, root, n, sig), sorted: the members that have a candidate within a pair of chunks."""
    for (bucket, slot, *_), rows in _grouped(batches, 4):
        own, keys, roots, n, signatures = zip(*rows, strict=True)
        own, n, roots = np.array(own), np.array(n), np.array(roots, np.int64)
        symbols, one_chunk, some = _signatures(signatures, len(rows)), len(set(own)) == 1, set()
        for i in range(len(rows)):
            near = _candidates(slot, n, roots, symbols, i)
            if not one_chunk:
                near = near[own[near] != own[i]]
            if len(near):
                some.update((i, *near.tolist()))
        if some:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(some), pa.int64()), "key": pa.array([keys[k] for k in sorted(some)], pa.int64())})


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (bucket, slot, a, b, own, key, root, n, sig, text), sorted: links between components within a pair of chunks."""
    for (_, slot, *_), rows in _grouped(batches, 4):
        yield from _forest(slot, rows)


def _forest(slot: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Confirmed links between members ``(own, key, root, n, sig, text)`` of different components; those linked are compared no more."""
    own, keys, roots, n, signatures, texts = zip(*rows, strict=True)
    parent = {r: r for r in roots}
    if len(parent) < 2:
        return

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    symbols, n, first = _signatures(signatures, len(rows)), np.array(n), np.array(roots, np.int64)
    sets, found, one_chunk = {}, [], len(set(own)) == 1
    for i in range(len(rows)):
        for j in _candidates(slot, n, first, symbols, i).tolist():
            if (own[i] == own[j] and not one_chunk) or (x := find(roots[i])) == (y := find(roots[j])):
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingles(texts[k], WIDTH)
            if similar(sets[i], sets[j]):
                parent[max(x, y)] = min(x, y)
                found.append((max(keys[i], keys[j]), min(keys[i], keys[j])))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets that aren't empty are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return both >= THRESHOLD * (len(a) + len(b) - both)


def _near(a: str, b: str) -> str:
    """A condition that two signatures are within the distance: differing symbols are counted in the JVM."""
    symbols = CHUNKS * ROWS
    return f"size(filter(sequence(0, {symbols - 1}), i -> substring({a}, 2 * i + 1, 2) <> substring({b}, 2 * i + 1, 2))) <= {DISTANCE}"


def _dealt(members: DataFrame, chunks: Column) -> DataFrame:
    """Members with ``own`` chunk and the pairs ``a, b`` of chunks in which it meets the others of its bucket; ``chunks`` is a column."""
    dealt = members.withColumn("chunks", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    # each chunk meets each other chunk and itself; with one chunk that is the bucket
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "chunks")


def rest_links(members: DataFrame, roots: DataFrame, known: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """Links between members of a bucket that are in different components so far.

    Signatures meet first, in large chunks; the texts of those that have a candidate meet in small ones.
    """
    others = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    others = materialize(others.select("bucket", "slot", "key", "root", "n", "sig", "bytes"))
    split = materialize(others.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("bucket", "rows"))
    group, row = ["bucket", "slot", "a", "b"], ["own", "key", "root", "n", "sig"]
    slim = _dealt(others.join(split, "bucket"), F.ceil(F.col("rows") / (8 * chunk)))
    slim = slim.repartition(*group).sortWithinPartitions(*group, "key").select(*group, *row)
    likely = materialize(slim.mapInArrow(_likely, "bucket long, key long").distinct())
    drop(split)
    left = materialize(others.join(likely, ["bucket", "key"]))
    size = materialize(left.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("bytes") / chunk_bytes)).alias("parts")))
    dealt = _dealt(left.join(size, "bucket"), F.col("parts")).join(known.hint("merge"), "key")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "key").select(*group, *row, "text")
    out = materialize(dealt.mapInArrow(_meet, "u long, v long"))
    drop(others, likely, left, size)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``id, version, n, component``: size of each row's set, and the smallest id that links reach from it.

    ``version`` is a hash of the whole text, which tells rows with the same id apart.
    """
    text = whole(text_col)
    texts = docs.select(lift(id_col).alias("id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    signed = materialize(spread(texts).mapInArrow(_signed, "id long, version long, n long, key long, sig binary, keys array<long>, bytes long"))
    own = materialize(signed.select("id", "version", "n", "key"))
    firsts = materialize(own.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "version")).alias("f")).select("key", "f.id", "f.version"))
    distinct = materialize(signed.join(firsts, ["key", "id", "version"]).dropDuplicates(["key"]).select("key", "keys", "n", "sig", "bytes"))
    drop(signed)
    bucketed = distinct.select("key", F.posexplode("keys").alias("slot", "bucket"))
    shared = materialize(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    pairs_of = materialize(bucketed.join(shared, "bucket"))
    weights = materialize(pairs_of.groupBy("key").agg(F.sum("n").alias("weight")))
    members = materialize(pairs_of.select("bucket", "slot", "key").join(distinct.join(weights, "key").select("key", "n", "sig", "bytes", "weight").hint("merge"), "key"))
    drop(distinct, shared, pairs_of)
    best = F.max(F.struct("weight", "key", "sig")).alias("c")
    centres = materialize(members.groupBy("bucket").agg(best).select("bucket", F.col("c.key").alias("v"), F.col("c.sig").alias("v_sig"), F.col("c.weight").alias("v_weight")))
    met = members.join(centres, "bucket").filter("key != v").groupBy(F.col("key").alias("u"), "v").agg(F.max("v_weight").alias("weight"), F.first("sig").alias("sig"), F.first("v_sig").alias("v_sig"))
    near = materialize(met.filter(_near("sig", "v_sig")).select("u", "v", "weight"))
    # one text of each key in a bucket, moved once however few there are
    asked = weights.select("key").join(firsts, "key").hint("merge")
    known = materialize(texts.join(asked, ["id", "version"]).groupBy("id", "version", "key").agg(F.first("text").alias("text")).select("key", "text"))
    pairs = materialize(near.groupBy("u").agg(F.max(F.struct("weight", "v")).alias("c")).select("u", "c.v"))
    direct = confirmed(pairs, known, WIDTH, THRESHOLD)
    roots = components(direct)
    others = materialize(apart(near.select("u", "v"), roots).join(pairs, ["u", "v"], "left_anti"))
    more = confirmed(others, known, WIDTH, THRESHOLD)
    joined = components(roots.toDF("u", "v").union(more))
    rest = rest_links(members, joined, known, chunk, chunk_bytes)
    ends = components(joined.toDF("u", "v").union(rest))
    rooted = materialize(firsts.join(ends.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("root", "key").alias("root")))
    smallest = materialize(rooted.groupBy("root").agg(F.min("id").alias("component")))
    by_key = materialize(rooted.join(smallest, "root").select("key", "component"))
    drop(firsts, members, weights, centres, near, known, pairs, others, direct, roots, more, joined, rest, ends, rooted, smallest)
    return own.join(by_key, "key", "left").select("id", "version", "n", F.coalesce("component", "id").alias("component"))


def minhash_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document."""
    g = near_groups(docs)
    return g.select(
        give_back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), give_back(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept")
    )
