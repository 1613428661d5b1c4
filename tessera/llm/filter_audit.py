"""How filters overlap: what each removes in every order, from one scan of the texts.

Texts are read where Arrow holds them: a table of byte classes turns the data buffer of a batch into blanks, capitals,
symbols and bytes that go on with a character, and differences of prefix sums at the offsets count them per document.  Words are
hashed eight bytes at a time for all words of a block at once and sorted by document and hash; neighbours with equal hashes are
compared byte for byte, and a document in which they differ is counted by its words themselves, so that no collision
changes a count.  A document longer than a block is cut at blanks, and its pieces' distinct words are sorted once more.

A document's failed filters are the bits of a mask.  Documents with the same part, mask and labels are one class with a number, and
all orders, steps and Shapley sums are sums over the classes: an order's step removes what fails its filter
and none before it, and over all n! orders a filter removes a class n! / (bits of the mask) times.

Copies are found by the SHA-256 of the text, in sums that are partly formed before each shuffle: no group is a task of its own.

Defined results.  A null text is empty, a null part the empty string.  A null id is the smallest id.  Rows that repeat
both id and text are no copies of each other; a row is a copy if a smaller id has its text.  A document is good (or toxic)
if one of its labels says so; labels without an id count for none.  A text without words fails no share of distinct words.  Texts of any
length are scanned whole.  An empty table has no parts and gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lift, spread, whole

#: Bytes that are scanned at once.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
BLANK, CAPITAL, SYMBOL, REST = 1, 2, 4, 8
SYMBOLS = b"#$%&*|"

_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\n\x0b\x0c\r")] = BLANK
_KINDS[ord("A") : ord("Z") + 1] = CAPITAL
_KINDS[list(SYMBOLS)] = SYMBOL
_KINDS[0x80:0xC0] = REST
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_TIMES = np.uint64(0x9E3779B97F4A7C15)

FACTS = ("words", "distinct", "capitals", "symbols", "points")


def _parts(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th eight bytes of words, with zeros after their ends."""
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    return eights[starts + 8 * k] & _MASKS[np.minimum(lengths - 8 * k, 8)]


def word_hashes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word; ``padded`` is the data with eight bytes more."""
    h = lengths.astype(np.uint64)
    for k in range(LONG // 8):
        at = np.flatnonzero((lengths > 8 * k) & (lengths <= LONG))
        if not len(at):
            break
        x = (h[at] ^ _parts(padded, starts[at], lengths[at], k)) * _TIMES
        h[at] = x ^ (x >> np.uint64(32))
    for at in np.flatnonzero(lengths > LONG):
        h[at] = xxhash.xxh64_intdigest(padded[starts[at] : starts[at] + lengths[at]])
    return h


def first_words(padded: np.ndarray, doc: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one word for each document and hash, and the documents in which words with one hash differ."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = word_hashes(padded, starts, lengths)
    order = np.lexsort((h, doc))
    a, b = order[:-1], order[1:]
    same = (doc[a] == doc[b]) & (h[a] == h[b])
    a, b = a[same], b[same]
    differ = lengths[a] != lengths[b]
    for k in range(LONG // 8):
        at = np.flatnonzero(~differ & (lengths[a] > 8 * k) & (lengths[a] <= LONG))
        if not len(at):
            break
        differ[at] = _parts(padded, starts[a[at]], lengths[a[at]], k) != _parts(padded, starts[b[at]], lengths[b[at]], k)
    for at in np.flatnonzero(~differ & (lengths[a] > LONG)):
        x, y = ((starts[w], starts[w] + lengths[w]) for w in (a[at], b[at]))
        differ[at] = padded[slice(*x)].tobytes() != padded[slice(*y)].tobytes()
    return order[np.concatenate(([True], ~same))], np.unique(doc[a[differ]])


def _counted(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of each document are set, by prefix sums."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)))
    return np.diff(sums[offsets])


def _scan_block(padded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Facts (row per document) of the documents between ``offsets``, the documents with a collision, and places of distinct words."""
    kinds = _KINDS[padded[: offsets[-1]]]
    blank = kinds == BLANK
    inner = ~blank
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    filled = np.flatnonzero(np.diff(offsets))
    begins[offsets[filled]] = inner[offsets[filled]]
    ends[offsets[filled + 1] - 1] = inner[offsets[filled + 1] - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    words = _counted(begins, offsets)
    doc = np.repeat(np.arange(len(words)), words)
    firsts, odd = first_words(padded, doc, starts, lengths)
    distinct = np.bincount(doc[firsts], minlength=len(words))
    counts = [_counted(kinds == kind, offsets) for kind in (CAPITAL, SYMBOL)]
    points = np.diff(offsets) - _counted(kinds == REST, offsets)
    return np.stack([words, distinct, *counts, points], 1), odd, starts[firsts], lengths[firsts], doc


def _scan_long(data: np.ndarray) -> np.ndarray:
    """Facts of one document that is longer than a block, cut at blanks."""
    total, starts, lengths, at, odd = np.zeros(len(FACTS), np.int64), [], [], 0, False
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # go on to the next blank, a block at a time
            blanks = np.flatnonzero(_KINDS[data[end : end + BLOCK]] == BLANK)
            end = end + int(blanks[0]) if len(blanks) else min(len(data), end + BLOCK)
            if len(blanks):
                break
        facts, differ, begun, long, _ = _scan_block(padded[at : end + 8], np.array([0, end - at]))
        total, odd = total + facts[0], odd or bool(len(differ))
        starts.append(begun + at)
        lengths.append(long)
        at = end
    starts, lengths = np.concatenate(starts), np.concatenate(lengths)
    firsts, differ = first_words(padded, np.zeros(len(starts), np.int64), starts, lengths)
    total[1] = len(set(data.tobytes().split())) if odd or len(differ) else len(firsts)
    return total


def scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``FACTS`` of the documents of one Arrow buffer: words, distinct words, capitals, symbols and code points."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi - lo > BLOCK:
            out.append(_scan_long(data[lo:hi])[None])
        else:
            own = offsets[first : last + 1].astype(np.int64) - lo
            facts, odd, *_ = _scan_block(np.concatenate((data[lo:hi], np.zeros(8, np.uint8))), own)
            for k in odd:  # the hash of two words is the same
                facts[k, 1] = len(set(data[lo + own[k] : lo + own[k + 1]].tobytes().split()))
            out.append(facts)
        first = last
    return np.concatenate(out) if out else np.zeros((0, len(FACTS)), np.int64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a column of strings or bytes without nulls."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            *kept, text = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in scan(*buffer_of(text)).T]], [*batch.schema.names[:-1], *FACTS])


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, digest`` and ``FACTS`` of each document; ``digest`` is the SHA-256 of the text."""
    text = whole(text_col)
    rows = docs.select(lift(id_col).alias("id"), whole(part_col).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    kinds = "id long, part string, digest binary, " + ", ".join(f"{f} long" for f in FACTS)
    return spread(rows).mapInArrow(_scanned, kinds)


#: The production filters, but for copies (E): SQL conditions on ``FACTS`` that hold if a document fails.
FILTERS = {
    "A": "words < 200",
    "B": "100 * distinct < 50 * words",
    "C": "100 * capitals > 3 * points",
    "D": "symbols > 0",
}
COPIES = "E"


def classes(facts: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """``part, mask, good, toxic, n``: how many documents fail just the filters of a mask; copies are the last bit.

    ``labels`` has ``doc_id, quality, toxic``.
    """
    filters = FILTERS if filters is None else filters
    mask = sum((F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    told = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(told("quality"), told("toxic"))
    # labels grow with the documents, so they are never sent to all tasks
    rows = facts.select("id", "part", "digest", mask.alias("mask")).join(known.hint("merge"), "id", "left")
    kind = ["digest", "part", "mask", "good", "toxic"]
    no = F.lit(False)
    rows = rows.withColumns({"good": F.coalesce("quality", no), "toxic": F.coalesce("toxic", no)}).groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    # of each text and kind: its rows, and those with the kind's smallest id
    kinds = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    texts = kinds.groupBy("digest").agg(F.min("first.id").alias("kept"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "first")).alias("kinds"))
    kinds = texts.select("kept", F.explode("kinds").alias("k")).select("k.*", F.when(F.col("k.first.id") == F.col("kept"), F.col("k.first.n")).otherwise(F.lit(0)).alias("own"))
    copies = F.col("mask").bitwiseOR(F.lit(1 << len(filters)))
    both = F.array(F.struct("mask", F.col("own").alias("n")), F.struct(copies.alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    return kinds.select("part", "good", "toxic", F.explode(both).alias("c")).groupBy("part", "c.mask", "good", "toxic").agg(F.sum("c.n").alias("n"))


def steps(letters: str) -> Column:
    """All orders of the filters and their steps, as a constant array: the step's bit, and the bits of those before it."""
    rows = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(found: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """What each step of each order keeps and removes, from :func:`classes`; one row a part, order and step, zeros included."""
    each = found.select("*", F.explode(steps(letters)).alias("s")).select("*", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    times = F.lit(factorial(len(letters))) / F.bit_count("mask")
    amount = lambda when, n=F.col("n"): F.sum(F.when(when, n).otherwise(F.lit(0))).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        amount(~fails & ~earlier).alias("kept"), amount(removed).alias("removed"), amount(fails & earlier).alias("redundant"),
        amount(F.col("mask") == F.col("bit")).alias("unique_fails"), amount(removed & F.col("good")).alias("good_lost"), amount(removed & F.col("toxic")).alias("toxic_lost"),
        amount(fails, F.round(F.col("n") * times).cast("long")).alias("shapley"),
    )


def audit_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return audit(classes(text_facts(docs), labels), "".join(FILTERS) + COPIES)
