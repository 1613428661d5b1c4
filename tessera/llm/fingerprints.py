"""Document fingerprints by consistent weighted sampling.

The terms of a text are its shingles of ``WIDTH`` words (A-Z lower-cased), weighted by how often
they occur.  For each of ``SAMPLES`` samples every term draws ``r`` and ``c`` from Gamma(2, 1) and
``beta`` from [0, 1).  With ``t = floor(ln w / r + beta)`` and ``ln y = r (t - beta)`` the term's key is
``a = c exp(-ln y - r)``; the smallest key wins, and ``(term, t)`` is the sample.  Two texts
share a sample with a chance equal to their generalised Jaccard similarity, so the share of equal samples
estimates it.

The three draws come from three exponential variates ``x``, ``x'``, ``e`` that are hashed from term and
sample: ``c = x + x'``, ``r = ln(c / x) + e``, ``beta = e / r``.  (A Gamma(2, 1) is the sum of two exponential
variates, and a part's share of the sum is uniform and independent of it.)  Then a term of weight 1 has
the key ``x``, and one of weight w the key ``x exp(-r t)``, which is at least ``x exp(-e) / w`` and at most ``x``.
So the least ``x`` of all terms bounds the least key, and only repeated terms that the lower bound lets
below it need ``x'`` and logarithms.

``next`` documents: ids are cut into ranges at approximate quantiles; a range is one task,
sorted by descending id, and streams neighbours past each other.  The first row
of each range is also sent to the range before it, as its last neighbour.  An id that fills several ranges
(null, say) is cut further by the hash of the text.

Defined results.  A null text is empty.  A text of fewer words than the width is one term; one
without words has a fingerprint of zeros, like only to its kind.  A null id is the smallest
id.  Rows that repeat an id follow each other in the order of a hash of their text; rows that repeat
both are alike, so their order does not matter.  A single row is its own next document.  An empty table gives
an empty result.  A very long text is one value; its terms are read in parts of bounded size.  Ties of keys go to
the term with the smaller hash.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, slices, whole

WIDTH = 5
SAMPLES = 64
_TERMS = 1024
_WORDS = 200_000
_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT_ARROW = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


class Sampler:
    """Signatures of texts in UTF-8."""

    def __init__(self, samples: int = SAMPLES, width: int = WIDTH, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.samples, self.width = samples, width
        # multipliers of the three hashed draws
        self._times = rng.integers(1, 1 << 32, (3, 2, samples), np.uint64).astype(np.uint32) | np.uint32(1)
        self._words: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self._words) >= _WORDS:
            self._words.clear()
        self._words[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct terms, ascending, and how often each occurs."""
        seen, fresh = self._words.get, self._word
        words = [h if (h := seen(w)) is not None else fresh(w) for w in text.lower().split()]
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.array(words, np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
            out ^= out >> np.uint64(29)
        return np.unique(out, return_counts=True)

    def signature(self, text: bytes) -> np.ndarray | None:
        """16 bits for each sample; null for a text without words."""
        hashes, counts = self.terms(text)
        return self.sample(hashes, counts) if len(hashes) else None

    def sample(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """16 bits for each sample of terms with weights of at least 1."""
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        own = (low ^ (high * np.uint32(0x85EBCA6B))) >> np.uint32(1)
        lanes = np.arange(self.samples)
        least, which = np.full(self.samples, 0xFFFFFFFF, np.uint32), np.zeros(self.samples, np.int64)
        for at in range(0, len(hashes), _TERMS):
            x = self._bits(0, low[at : at + _TERMS], high[at : at + _TERMS])
            first = x.argmin(1)
            best = x[lanes, first]
            less = best < least
            least[less], which[less] = best[less], at + first[less]
        key, chosen = self._exponential(least), own[which]
        often = np.flatnonzero(counts > 1)
        for at in range(0, len(often), _TERMS):
            part = often[at : at + _TERMS]
            weights = counts[part]
            x = self._bits(0, low[part], high[part])
            e = self._bits(2, low[part], high[part])
            # the lower bound of the key, up to rounding, against the least key so far
            limit = (key * 1.001 * 2.0**64)[:, None] * weights
            lane, term = np.nonzero(np.multiply(x, e, dtype=np.float64) <= limit)
            if not len(lane):
                continue
            rest = self._bits(1, low[part][term], high[part][term], lane)
            x, e = self._exponential(x[lane, term]), -np.log(_unit(e[lane, term]))
            r = np.log1p(self._exponential(rest) / x) + e
            t = np.floor((np.log(weights[term]) + e) / r)
            a = x * np.exp(-r * t)
            order = np.lexsort((term, a, lane))
            first = order[np.unique(lane[order], return_index=True)[1]]
            first = first[a[first] < key[lane[first]]]
            key[lane[first]] = a[first]
            chosen[lane[first]] = own[part[term[first]]] + t[first].astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
        chosen ^= chosen >> np.uint32(15)
        return ((chosen * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)

    def _exponential(self, bits: np.ndarray) -> np.ndarray:
        """Exponential variates that ascend with the bits."""
        return -np.log1p(-_unit(bits))

    def _bits(self, draw: int, low: np.ndarray, high: np.ndarray, lane: np.ndarray | None = None) -> np.ndarray:
        """32 hashed bits: (samples, terms), or one for each term and its ``lane``."""
        a, b = (m[:, None] if lane is None else m[lane] for m in self._times[draw])
        x = low * a
        x += high * b
        y = np.empty_like(x)
        for shift, odd in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 0)):
            np.right_shift(x, np.uint32(shift), out=y)
            x ^= y
            if odd:
                x *= np.uint32(odd)
        return x

    def text_of(self, signature: np.ndarray | None) -> str:
        return "0" * (4 * self.samples) if signature is None else signature.astype(">u2").tobytes().hex()


def _unit(bits: np.ndarray) -> np.ndarray:
    """32 bits as a number between 0 and 1, never either."""
    return (bits + 0.5) / 2.0**32


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the next document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (range, guest, id, text), sorted: each row with the row after it in its range."""
    sampler, schema = Sampler(), _OUT_ARROW
    held: tuple | None = None  # (range, id, text, signature) of the row before
    for batch in slices(batches):
        rows = []
        for bucket, _guest, ident, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0] != bucket:
                raise ValueError("a range ended without its last neighbour")
            if _guest and not held:
                continue  # only the first guest of a range counts
            own = sampler.signature(text.encode())
            if held:
                edited = edit(held[2], text).encode()
                other = sampler.signature(edited)
                rows.append((held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), sampler.text_of(held[3]), sampler.text_of(other), likeness(held[3], other), likeness(held[3], own)))
            held = None if _guest else (bucket, ident, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if held:
        raise ValueError("a range ended without its last neighbour")


def _ranges(df: DataFrame, cuts: list[int]) -> DataFrame:
    """Add ``bucket`` to ``id, version``: the range between cuts, found by bisection; 0 has the largest ids.

    Ids are compared as doubles, which keeps their order.  A cut that several quantiles fall on is an id
    that fills ranges: it gets as many of its own, by ``version``.
    """
    bounds = sorted({float(x) for x in cuts})
    if not bounds:
        return df.withColumn("bucket", F.lit(0))
    split = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_id", outputCol="_range")
    found = split.transform(df.withColumn("_id", F.col("id").cast("double")))
    place = (F.lit(len(bounds)) - F.col("_range")).cast("int")
    for ident, times in Counter(cuts).items():
        if times > 1:
            here = F.lit(len(bounds)) - F.lit(bounds.index(float(ident)) + 1)
            part = F.floor((F.col("version") / F.lit(2.0**64) + 0.5) * times)
            own = F.when(F.col("id") > ident, 0).when(F.col("id") == ident, 1 + F.least(part, F.lit(times - 1))).otherwise(times + 1)
            before = F.lit(len(bounds)) - F.col("_range")
            place = place + F.when(before > here, times + 1).when(before == here, own).otherwise(0)
    return found.withColumn("bucket", place.cast("int")).drop("_id", "_range")


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint and that of its edited text, with likenesses."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(lift(id_col).alias("id"), whole(text_col).alias("text")).select("id", F.xxhash64("text").alias("version"), "text")
    levels = [k / n for k in range(1, n)]
    cuts = list(d.agg(F.percentile_approx("id", levels, 100 * n)).first()[0] or []) if levels else []
    # one row a range, at most twice as many as partitions: the first of each in order of descending ids
    last = F.max(F.struct("id", F.bitwise_not("version").alias("v")))
    ids = d.select("id", "version" if len(set(cuts)) < len(cuts) else F.lit(0).cast("long").alias("version"))
    firsts = _ranges(ids, cuts).groupBy("bucket").agg(last).orderBy("bucket").collect()
    homes = [(first.id, ~first.v, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    rows = _ranges(d, cuts)
    on = ["id", "version"] if len(set(cuts)) < len(cuts) else ["id"]
    rows = rows.join(F.broadcast(spark.createDataFrame(homes, "id long, version long, home int").select(*on, "home")), on, "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("home").alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("home").isNull(), F.array(own)).otherwise(F.array(own, visit))))
    rows = rows.select("place.bucket", "place.guest", "id", "version", "text").repartitionById(n, F.col("bucket"))
    rows = rows.sortWithinPartitions("bucket", "guest", F.col("id").desc(), "version").select("bucket", "guest", "id", "text")
    out = rows.mapInArrow(_stream, _OUT)
    return out.select(give_back(F.col("id")).alias("doc_id"), *[c for c in out.columns if c != "id"])
