"""Best-fit packing by swap-based local search.

A document's tokens are its ids and a closing ``END``.  Documents longer than a sequence are
cut into whole sequences and a rest.  Pieces are dealt by hash into groups of about
``GROUP`` pieces; a group is packed by best fit over pieces in descending length, then
local search works on its underfull bins: the lightest bin's pieces are moved to
fuller bins, or exchanged for one or for two smaller ones, each step
increasing the sum of squared fills.  The search looks at all underfull bins, through an index by the length that
leaves a bin and the bin's room, and ends when no step improves, or when the sum of lengths needs all
bins.  The number of groups follows the number of pieces, so a group's size does not grow with the
input; rows that repeat share a hash, and a group that they fill beyond twice its share is dealt on by the rows' places.

Token ids come from a ``tokenizers`` file whose path is a parameter.  Where the file's own normaliser
and pre-tokenizer are the ones below, which never join across white space, a text is tokenized as its parts between
blanks, with a bounded cache of parts seen before; results equal those of the whole text.  Any other file
gets whole texts.

Defined results.  A null or empty text is the single token ``END``.  A null id is the smallest
id.  Rows that repeat an id are packed on their own.  Pieces of equal length are taken in order of id, piece and
content.  A very long text is many whole sequences and a rest.  An empty table gives an empty result.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, materialize, slices, spread

LENGTH = 2048
END = 0
GROUP = 20_000
#: How many parts of a text, and words of parts, a task remembers.
_CACHED, _CACHED_CHARS = 300_000, 24
# Fixed values of the tokenizer file: its normaliser and pre-tokenizer, and its pattern for texts of these characters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_SPECIAL = "<|"
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[ \t\n\r]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    With the normaliser and pre-tokenizer above, a part between blanks is looked up whole.  A new part
    of plain characters is split by the tokenizer's pattern and its words go to the tokenizer's model one by
    one; any other part goes to the whole tokenizer.  With others, whole texts do.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self._encode, self._model = tokenizer.encode, tokenizer.model.tokenize
        own = json.loads(tokenizer.to_str())
        specials = [t["content"] for t in own["added_tokens"]]
        expected = own["normalizer"] == _NORMALIZER and own["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        self.in_parts = expected and all(t.startswith(_SPECIAL) and not _BLANK.search(t) for t in specials)
        self._parts: dict[str, bytes] = {"": b""}
        self._words: dict[str, bytes] = {}
        # the byte-level alphabet, as the library itself spells each byte of plain text
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = lambda c: level.pre_tokenize_str(c)[0][0]
        self._spelling = {ord(c): spelled(c) for c in map(chr, (*range(33, 127), *range(192, 256)))}

    def _word(self, word: str) -> bytes:
        if (out := self._words.get(word)) is None:
            out = np.array([t.id for t in self._model(word.translate(self._spelling))], "<u4").tobytes()
            if len(self._words) < _CACHED and len(word) <= _CACHED_CHARS:
                self._words[word] = out
        return out

    def _part(self, part: str) -> bytes:
        if _SPECIAL not in part and _PLAIN.fullmatch(part):
            out = b"".join(map(self._word, _WORDS.findall(part.lower())))
        else:
            out = np.array(self._encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self._parts) < _CACHED and len(part) <= _CACHED_CHARS:
            self._parts[part] = out
        return out

    def forget(self) -> None:
        """Drop what was seen; a worker would hold it in the tasks of later stages, too."""
        self._parts, self._words = {"": b""}, {}

    def __call__(self, text: str) -> np.ndarray:
        if not self.in_parts:
            return np.array(self._encode(text, add_special_tokens=False).ids, "<u4")
        seen, fresh = self._parts.get, self._part
        # str.split() also splits at four separators that the tokenizer takes for signs
        parts = _BLANK.split(text) if _SEPARATORS.search(text) else text.split()
        return np.frombuffer(b"".join([seen(p) or fresh(p) for p in parts]), "<u4")


@functools.lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    """One for each worker process."""
    return Tokens(path)


def _pieces(path: str, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokens(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((ident, k, at, len(part), zlib.crc32(part.tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])
        ids_of.forget()

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of all pieces of all documents, written once."""
    d = docs.select(lift("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return materialize(spread(d).mapInArrow(_pieces(tokenizer or default_tokenizer(), length), "id long, piece int, start long, length long, ids_crc32 long"))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places in ``sizes``: best fit, longest first."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(k)
        by_room[room - size].append(at)
        some |= 1 << (room - size)
    return bins


class _Exchanges:
    """Underfull bins by what may leave them: nothing, a piece, or two pieces, and by their room.

    ``rooms[out]`` has bit r where a bin of room r can let pieces of ``out`` in all go; ``most[out]`` is the
    largest such r, or -1.
    """

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.rooms, self.most = [0] * (capacity + 1), np.full(capacity + 1, -1, np.int64)
        self._bins: dict[tuple[int, int], dict[int, None]] = {}
        self._outs: dict[int, tuple[int, list[int]]] = {}

    def add(self, number: int, own: list[int], room: int) -> None:
        lengths = np.unique(self.sizes[own])
        counts = self.sizes[own]
        two = np.unique(np.add.outer(counts, counts)[np.triu_indices(len(counts), 1)]) if len(counts) > 1 else lengths[:0]
        outs = np.union1d(np.append(lengths, 0), two[two <= self.capacity]).tolist()
        self._outs[number] = room, outs
        for out in outs:
            there = self._bins.setdefault((out, room), {})
            there[number] = None
            if len(there) == 1:
                self.rooms[out] |= 1 << room
                self.most[out] = max(self.most[out], room)

    def remove(self, number: int) -> None:
        room, outs = self._outs.pop(number)
        for out in outs:
            there = self._bins[out, room]
            del there[number]
            if not there:
                self.rooms[out] &= ~(1 << room)
                self.most[out] = self.rooms[out].bit_length() - 1

    def best(self, size: int, below: int) -> tuple[int, int] | None:
        """The bin that gains most from a piece of ``size``, and what leaves it; the fullest of equals.

        Its room is less than ``below`` plus the gain, so that mass goes to the fuller bin.
        """
        gains = size - np.arange(size)
        for out in np.flatnonzero(self.most[:size] >= gains).tolist():
            fits = self.rooms[out] >> (size - out)
            room = size - out + (fits & -fits).bit_length() - 1
            if room < below + size - out:
                return next(iter(self._bins[out, room])), out
        return None


def _leaving(own: list[int], sizes: np.ndarray, out: int) -> list[int]:
    """One or two pieces of a bin that are ``out`` long in all."""
    if not out:
        return []
    seen: dict[int, int] = {}
    for k in own:
        size = int(sizes[k])
        if size == out:
            return [k]
        if out - size in seen:
            return [seen[out - size], k]
        seen.setdefault(size, k)
    raise ValueError("the index of exchanges is out of step with its bins")


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and swaps that increase the sum of squared fills, until none does.

    The lightest bins come first.  After a round in which something improved all bins are tried again, as a
    bin that was stuck may go on with what others now hold.
    """
    fill = [int(sizes[b].sum()) for b in bins]
    open_bins = [n for n, f in enumerate(fill) if 0 < f < capacity]
    spare = sum(f > 0 for f in fill) - -(-int(sizes.sum()) // capacity)
    if spare <= 0 or len(open_bins) < 2:
        return [b for b in bins if b]
    index = _Exchanges(sizes, capacity)
    for n in open_bins:
        index.add(n, bins[n], capacity - fill[n])
    improved = True
    while improved and spare > 0:
        improved = False
        for light in sorted(open_bins, key=lambda n: (fill[n], n)):
            if not 0 < fill[light] < capacity:
                continue
            index.remove(light)
            going = True
            while going and fill[light] and spare > 0:
                going = False
                for item in sorted(bins[light], key=lambda k: -sizes[k]):
                    size = int(sizes[item])
                    if found := index.best(size, capacity - fill[light]):
                        to, out = found
                        gone = _leaving(bins[to], sizes, out)
                        index.remove(to)
                        bins[light] = [k for k in bins[light] if k != item] + gone
                        bins[to] = [k for k in bins[to] if k not in gone] + [item]
                        fill[light] += out - size
                        fill[to] += size - out
                        if fill[to] < capacity:
                            index.add(to, bins[to], capacity - fill[to])
                        spare -= not fill[light]
                        going = improved = True
                        break
            if fill[light]:
                index.add(light, bins[light], capacity - fill[light])
        open_bins = [n for n in open_bins if 0 < fill[n] < capacity]
    return [b for b in bins if b]


def _pack(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy(np.int64)
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for n, own in enumerate(bins):
            sequence[own] = int(rows["number"].iat[0]) * (1 << 24) + n
            offset[own] = np.cumsum(sizes[own]) - sizes[own]
        return rows.drop(columns=["group", "part", "number"]).assign(sequence_id=sequence, offset=offset)

    return run


def pack(items: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces."""
    groups = max(1, -(-items.count() // group))
    dealt = items.withColumn("group", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.lit(groups)))
    # groups that repeated rows fill: at most one for 2 * group pieces
    large = materialize(dealt.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * group).select("group", F.ceil(F.col("n") / group).alias("parts")))
    dealt = dealt.withColumn("row", F.monotonically_increasing_id()).join(large, "group", "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("long")).drop("row", "parts")
    dealt = dealt.withColumn("number", F.col("part") * groups + F.col("group"))
    kind = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("group", "part").applyInPandas(_pack(capacity), kind)


def packing_report(docs: DataFrame) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece."""
    p = pack(pieces(docs))
    return p.select(give_back(F.col("id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
