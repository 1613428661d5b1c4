"""Language ID by error-correcting output codes.

Each language has a codeword of bits.  For every bit a logistic model over hashed
character trigrams (relative counts, square-rooted) predicts whether the text's language has the
bit.  Decoding adds up, per language, the logistic loss of all bits against its
codeword and takes the least; the soft-min of the losses is the score.  A text is
``ambiguous`` when the runner-up is within ``MARGIN`` of loss per bit, or when no codeword is near.

Training reads whole texts of a sample of labelled documents: those with the smallest hashes of id and text, at
most about ``SAMPLE`` in all (and, where there are many languages, at least ``LEAST`` of each), shared evenly by
the languages.  The bit models are trained until no slope of the loss is above ``SLOPE``.  Prediction sees
nothing but the text.

Defined results.  A null text, or one without a letter, is ``und`` with score 0 and not
ambiguous.  Rows with a null language aren't learned from.  Without any
learnable row, every text is ``und``.  A null id counts as held in (its row is never held out).
Rows that repeat an id are predicted on their own.  Ties of losses go to the language that is first by code point.  A
very long text is read whole, in pieces of bounded size.  An empty table gives an empty result.  Other columns are
ignored, whatever their names; the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, lift, slices, spread

BITS = 13
SAMPLE = 3_000
LEAST = 20
SLOPE, ROUNDS = 5e-4, 2_000
MARGIN = 0.02
_PIECE = 1 << 18
_FOUND = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
_A, _B, _C = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D


def trigram_counts(text: str) -> np.ndarray:
    """Hashed counts of the character trigrams of a whole text, in pieces of bounded size."""
    counts = np.zeros(1 << BITS, np.float64)
    for at in range(0, max(1, len(text)), _PIECE):
        piece = (text[max(0, at - 2) : at + _PIECE] if at else " " + text[:_PIECE]) + (" " if at + _PIECE >= len(text) else "")
        c = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), np.uint32)
        if len(c) < 3:
            continue
        h = c[:-2] * np.uint32(_A) + c[1:-1] * np.uint32(_B) + c[2:] * np.uint32(_C)
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * np.uint32(_A)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return counts


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of the counts."""
    counts = trigram_counts(text)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """Codes of -1 and 1, a row per language: all splits up to 5 languages, else far-apart random ones."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for s in splits] for k in range(n)], np.float32)
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        gaps = (width - code @ code.T) / 2 + np.eye(n) * width
        if gaps.min() > distance and (np.abs(code.sum(0)) < n).all():
            best, distance = code, gaps.min()
    return best if best is not None else code


def train_bits(x: np.ndarray, code: np.ndarray, weight: np.ndarray, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic models (features x bits, biases) by accelerated gradient descent; ``code`` has each row's bits.

    It ends when no slope is above ``SLOPE``, or after ``ROUNDS`` rounds.
    """
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    weight = (weight / weight.sum())[:, None]
    used = np.flatnonzero(x.any(0))  # the others have no slope
    x = np.ascontiguousarray(x[:, used])
    for k in range(ROUNDS):
        slope = -code * weight / (1 + np.exp(np.clip(code * (x @ vw[used] + vb), -30, 30)))
        down, down_b = x.T @ slope + decay * vw[used], slope.sum(0)
        if max(np.abs(down).max(initial=0), np.abs(down_b).max(initial=0)) < SLOPE:
            break
        nw, nb = vw.copy(), vb - rate * down_b
        nw[used] -= rate * down
        pull = k / (k + 3)
        vw, vb = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    """Languages, their codewords and the bit models."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray):
        self.langs, self.code, self.w, self.b = langs, code, w, b

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) of rows of features."""
        margins = x @ self.w + self.b
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
        best = loss.argmin(1)
        soft = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        ordered = np.sort(loss, 1)
        close = ordered[:, 1] - ordered[:, 0] < MARGIN if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return best, 1 / soft.sum(1), close | (ordered[:, 0] > np.log(2))


def held_out(ident: F.Column, folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = 5) -> Model | None:
    """A model from labelled rows that aren't held out; null without any."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds))
    counts = dict(d.groupBy("lang").agg(F.count(F.lit(1))).orderBy("lang").collect())
    if not counts:
        return None
    share = max(LEAST, sample // len(counts))
    # half as many again, and a few, so that a language's smallest hashes are surely among them
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * share + LEAST) / n))]), F.col("lang"))
    d = d.withColumn("h", F.xxhash64(F.lit("sample"), lift("doc_id"), F.xxhash64("text")))
    chosen = d.filter(F.col("h") / F.lit(2.0**64) + 0.5 <= rate)

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("at", pa.list_(pa.int16())), ("x", pa.list_(pa.float32()))])
        for batch in slices(batches):
            rows = []
            for lang, h, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if has_letter(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    rows.append({"lang": lang, "h": h, "at": at.astype(np.int16), "x": x[at]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    got = chosen.select("lang", "h", "text").mapInArrow(sparse, "lang string, h long, at array<short>, x array<float>").toArrow()
    names, hashes = got.column("lang").to_pylist(), got.column("h").to_pylist()
    taken: dict[str, int] = {}
    order = []
    for k in sorted(range(got.num_rows), key=lambda k: (names[k], hashes[k])):  # rows arrive in any order
        taken[names[k]] = taken.get(names[k], 0) + 1
        if taken[names[k]] <= share:
            order.append(k)
    if not order:
        return None
    langs = sorted(taken)
    x = np.zeros((len(order), 1 << BITS), np.float32)
    for row, k in enumerate(order):
        x[row, got.column("at")[k].values.to_numpy()] = got.column("x")[k].values.to_numpy()
    y = np.array([langs.index(names[k]) for k in order])
    code = codewords(len(langs))
    w, b = train_bits(x, code[y], 1.0 / np.bincount(y)[y].astype(np.float32))
    return Model(langs, code, w, b)


def predicted(model: Model | None, texts: list[str | None]) -> list[pa.Array]:
    """``lang_pred, score, ambiguous`` of texts."""
    langs, scores, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    known = [k for k, t in enumerate(texts) if model and has_letter(t)]
    for at in range(0, len(known), 64):
        some = known[at : at + 64]
        for k, best, score, odd in zip(some, *model.decode(np.stack([features(texts[k]) for k in some])), strict=True):
            langs[k], scores[k], close[k] = model.langs[best], float(score), bool(odd)
    return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())]


def predictor(model: Model | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, text): adds ``lang_pred, score, ambiguous``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *predicted(model, batch.column(1).to_pylist())], names=[batch.schema.names[0], "lang_pred", "score", "ambiguous"])

    return run


def told(model: Model | None) -> Callable[[Column], Column]:
    """For a column of texts: a struct of ``lang_pred, score, ambiguous``.  Only the texts go to Python, and only this comes back."""

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        parts = [pa.StructArray.from_arrays(predicted(model, part.column(0).to_pylist()), fields=list(_FOUND)) for part in slices([batch])]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(_FOUND))

    # as if it were not deterministic: else Spark asks once for the filter and again for the result
    return F.arrow_udf(run, "lang_pred string, score double, ambiguous boolean").asNondeterministic()


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of each document."""
    model = train(docs)
    d = docs.select(lift("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    out = spread(d).mapInArrow(predictor(model), "id long, lang_pred string, score double, ambiguous boolean")
    ident = give_back(F.col("id"))
    return out.select(ident.alias("doc_id"), held_out(ident).alias("held_out"), "lang_pred", "score", "ambiguous")


def language_stage(docs: DataFrame) -> DataFrame:
    """The documents whose language is told without ambiguity, with that as ``lang``."""
    model = train(docs)
    names = docs.columns
    out = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), told(model)(F.col("text").cast("string")).alias("found"))
    kept = out.filter((F.col("found.lang_pred") != "und") & ~F.col("found.ambiguous"))
    return kept.select(*[F.col("found.lang_pred").alias("lang") if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in names])
