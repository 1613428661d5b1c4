"""Product, scalar, one-bit and chained quantizers."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, over_rows, to_matrix
from ..storage import drop, materialize
from . import blocks
from .additive import LocalSearchQuantizer, ResidualQuantizer, product_of
from .search import batch_top_k


class Codec(Protocol):
    """What codes batches of vectors, and makes vectors of codes."""

    def encode(self, x: np.ndarray) -> np.ndarray: ...

    def decode(self, codes: np.ndarray) -> np.ndarray: ...


class ProductQuantizer:
    """Codewords per subspace, after an orthonormal rotation.

    ``centroids`` is (subspaces, codes, width).  A code is the codeword with the largest inner
    product with its part of the rotated vector; the first of equals wins.
    """

    def __init__(self, centroids: np.ndarray, transform: np.ndarray | None = None):
        self.centroids = np.asarray(centroids, np.float64)
        self.subspaces, self.codes, self.width = self.centroids.shape
        self.transform = np.eye(self.subspaces * self.width) if transform is None else np.asarray(transform, np.float64)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.transform.T

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = self.rotate(x).reshape(len(x), self.subspaces, self.width)
        return np.einsum("nsw,scw->nsc", parts, self.centroids).argmax(2).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        parts = self.centroids[np.arange(self.subspaces)[None, :], codes]
        return parts.reshape(len(codes), -1) @ self.transform

    def table(self, query: np.ndarray) -> np.ndarray:
        """(subspaces, codes) inner products of a query's parts with all codewords."""
        return np.einsum("sw,scw->sc", self.rotate(query[None])[0].reshape(self.subspaces, self.width), self.centroids)

    def scores(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products from a query's table."""
        return table[np.arange(self.subspaces)[None, :], codes].sum(1)


def train_pq(sample: np.ndarray, subspaces: int, codes: int, rounds: int = 15, seed: int = 0, rotate: bool = True, queries: np.ndarray | None = None) -> ProductQuantizer:
    """Alternate codewords (k-means by subspace) and rotation (by SVD) on a bounded sample.

    With ``queries``, errors count by what queries see of them: vectors are weighted into the queries'
    second-moment metric before they are fitted.
    """
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    width = d // subspaces
    metric = np.eye(d)
    if queries is not None:
        values, vectors = np.linalg.eigh(queries.T @ queries / len(queries))
        metric = (vectors * np.sqrt(np.maximum(values, values.max() * 1e-3) / values.mean())) @ vectors.T
    seen = sample @ metric
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0] if rotate else np.eye(d)
    books = (seen @ turn.T)[rng.choice(n, min(codes, n), replace=False)].reshape(-1, subspaces, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        parts = (seen @ turn.T).reshape(n, subspaces, width)
        rebuilt = np.empty_like(parts)
        for s in range(subspaces):
            far = ((parts[:, s, None] - books[s][None]) ** 2).sum(2)
            own = far.argmin(1)
            for c in range(len(books[s])):
                if (own == c).any():
                    books[s, c] = parts[own == c, s].mean(0)
            rebuilt[:, s] = books[s][own]
        if rotate:
            u, _, v = np.linalg.svd(rebuilt.reshape(n, d).T @ seen)
            turn = u @ v
    if queries is not None:  # back from the metric: refit codewords on the rotated vectors themselves
        parts = (sample @ turn.T).reshape(n, subspaces, width)
        fitted = (seen @ turn.T).reshape(n, subspaces, width)
        for s in range(subspaces):
            own = ((fitted[:, s, None] - books[s][None]) ** 2).sum(2).argmin(1)
            for c in range(len(books[s])):
                if (own == c).any():
                    books[s, c] = parts[own == c, s].mean(0)
    return ProductQuantizer(books, turn)


def query_moment(queries: DataFrame, vector: str = "embedding") -> np.ndarray:
    """The mean outer product of all queries with themselves; what reaches the driver is dimensions squared."""

    def sums(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))
                total, n = x.T @ x if total is None else total + x.T @ x, n + len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "n": np.full(total.size, n), "x": total.ravel()})

    parts = queries.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, "i long, j long, n long, x double")
    rows = parts.groupBy("i", "j").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("i", "j").toArrow()
    d = round(rows.num_rows**0.5)
    return rows.column("x").to_numpy().reshape(d, d)


def query_loss(model: Codec, x: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Per vector, the mean over queries of the squared product of a query with what the code leaves out."""
    rest = x - model.decode(model.encode(x))
    return ((rest @ moment) * rest).sum(1)


def query_error(vectors: DataFrame, models: dict[str, Codec], moment: np.ndarray, vector: str = "embedding") -> DataFrame:
    """One row: ``n`` and, by model, the mean of :func:`query_loss` over all vectors that aren't null."""
    loss = lambda model: over_rows(lambda x: query_loss(model, x, moment), "double")(vector)
    rows = vectors.filter(F.col(vector).isNotNull()).select(*[loss(m).alias(k) for k, m in models.items()])
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in models])


def query_aware(start: ProductQuantizer, sample: np.ndarray, moment: np.ndarray, rounds: int = 30, steps: int = 5, rate: float = 0.5) -> ProductQuantizer:
    """Codewords and rotation of least :func:`query_loss` over a bounded sample, from a given quantizer by gradient descent.

    A round assigns codes as ``encode`` does, takes ``steps`` steps on the codewords, and one on the rotation, which is then made orthonormal again.  A round
    that does not help is undone and the steps get shorter, so the loss never rises.
    """
    best, least = start, float(query_loss(start, sample, moment).mean())
    size = rate / max(float(np.linalg.eigvalsh(moment)[-1]), 1e-12)
    for _ in range(rounds):
        books, turn = best.centroids.copy(), best.transform.copy()
        codes = best.encode(sample)
        places = np.arange(best.subspaces)
        counts = np.maximum(np.stack([np.bincount(codes[:, s], minlength=best.codes) for s in places]), 1)
        for _ in range(steps):
            rest = sample - books[places, codes].reshape(len(sample), -1) @ turn
            pull = (rest @ moment @ turn.T).reshape(len(sample), best.subspaces, best.width)
            for s in places:
                total = np.zeros_like(books[s])
                np.add.at(total, codes[:, s], pull[:, s])
                books[s] += size * total / counts[s][:, None]
        flat = books[places, codes].reshape(len(sample), -1)
        rest = sample - flat @ turn
        step = flat.T @ (rest @ moment) / max(float((flat * flat).sum(1).mean()), 1e-12) / len(sample)
        u, _, v = np.linalg.svd(turn + size * step)
        for model in (ProductQuantizer(books, u @ v), ProductQuantizer(books, turn)):
            loss = float(query_loss(model, sample, moment).mean())
            if loss < least:
                best, least = model, loss
                break
        else:
            size /= 2
    return best


def pq_encode(vectors: DataFrame, quantizer: ProductQuantizer, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, codes``, null for a null vector; the model is sent once per task."""
    encode = over_rows(lambda x: quantizer.encode(x).astype(np.int32), "array<int>")
    return vectors.select(key, encode(vector).alias("codes"))


def adc_score(codes: Column | str, table: np.ndarray) -> Column:
    """Approximate inner product of a query with codes, JVM-side, from the query's table."""
    flat = F.array(*[F.lit(float(v)) for v in table.ravel()])
    width = table.shape[1]
    placed = F.transform(codes, lambda c, i: F.get(flat, i * width + c))
    return F.aggregate(placed, F.lit(0.0), lambda s, x: s + x)


def adc_top_k(coded: DataFrame, quantizer: ProductQuantizer, query: np.ndarray, k: int, vectors: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", widen: int = 10) -> DataFrame:
    """The best ``k`` by codes; with ``vectors``, the best ``widen * k`` by codes in exact order."""
    table = quantizer.table(np.asarray(query, np.float64))
    near = coded.withColumn("approx", adc_score("codes", table)).orderBy(F.col("approx").desc(), key)
    if vectors is None:
        return near.limit(k).select(key, F.col("approx").alias("score"))
    q = F.array(*[F.lit(float(x)) for x in query])
    again = F.broadcast(near.limit(widen * k).select(key)).join(vectors.select(key, vector), key)
    return again.withColumn("score", dot(vector, q)).orderBy(F.col("score").desc(), key).limit(k).select(key, "score")


def adc_batch_top_k(vectors: DataFrame, queries: DataFrame, quantizer: ProductQuantizer, k: int, widen: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank``: for every query the best ``widen * k`` by codes, in exact order.

    Vectors are judged by what their codes decode to; exact products decide among the ``widen * k`` that are left.
    """
    dims = quantizer.subspaces * quantizer.width

    @F.pandas_udf("array<double>")
    def rebuilt(x: pd.Series) -> pd.Series:
        return pd.Series(list(quantizer.decode(quantizer.encode(np.stack(x.to_numpy()).astype(np.float64))).reshape(len(x), dims))) if len(x) else pd.Series([], dtype=object)

    coded = vectors.filter(F.col(vector).isNotNull()).select(key, rebuilt(vector).alias(vector))
    near = batch_top_k(coded, queries, widen * k, key, vector=vector).select("query_id", key)
    pairs = near.join(vectors.select(key, F.col(vector).alias("_x")), key).join(queries.select("query_id", F.col(vector).alias("_q")), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    exact = pairs.withColumn("score", dot("_x", "_q")).withColumn("rank", F.row_number().over(order).cast("long"))
    return exact.filter(F.col("rank") <= k).select("query_id", key, "score", "rank")


def codeword_table(quantizer_rows: DataFrame, subspaces: int, vector: str = "embedding") -> DataFrame:
    """``subspace, code, codeword`` from rows ``code, embedding``: each vector's parts are codewords."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda s: F.struct(s.alias("subspace"), F.slice(vector, s * (F.size(vector) / subspaces).cast("int") + 1, (F.size(vector) / subspaces).cast("int")).alias("codeword")))
    return quantizer_rows.select("code", F.explode(parts).alias("p")).select("p.subspace", "code", "p.codeword")


def scalar_codes(vector: Column | str, low: Column, high: Column) -> Column:
    """8 bits per dimension between its bounds."""
    return F.transform(
        F.arrays_zip(F.col(vector).alias("x") if isinstance(vector, str) else vector.alias("x"), low.alias("lo"), high.alias("hi")),
        lambda z: F.least(F.lit(255), F.greatest(F.lit(0), F.round((z["x"] - z["lo"]) * (255 / (z["hi"] - z["lo"]))))).cast("int"),
    )


def integer_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


class OneBitQuantizer:
    """Signs of a random rotation of centred unit vectors, and the correction for inner products."""

    def __init__(self, mean: np.ndarray, seed: int = 0, turn: np.ndarray | None = None):
        self.mean = np.asarray(mean, np.float64)
        d = len(self.mean)
        self.turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0] if turn is None else turn

    def packed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like :meth:`encode` with 64 signs a word, the first in the lowest bit."""
        bits, norms, align = self.encode(x)
        padded = np.zeros((len(x), -(-bits.shape[1] // 64) * 64), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8"), norms, align

    def planes(self, query: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
        """A query for packed codes: bit planes (``QUERY_BITS``, words) of its rotated values in steps from the least, the least, the step, their sum, and its product with the mean."""
        q = self.turn @ query
        low = float(q.min())
        step = float(q.max() - low) / ((1 << QUERY_BITS) - 1) or 1.0
        steps = np.round((q - low) / step).astype(np.int64)
        padded = np.zeros(-(-len(q) // 64) * 64, np.int64)
        padded[: len(q)] = steps
        bits = (padded[None] >> np.arange(QUERY_BITS)[:, None] & 1).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view("<u8"), low, step, low * len(q) + step * float(steps.sum()), float(query @ self.mean)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits, norms of what is left of the mean, and how well the bits align with it."""
        rest = x - self.mean
        norms = np.linalg.norm(rest, axis=1)
        unit = (rest / np.maximum(norms, 1e-12)[:, None]) @ self.turn.T
        bits = unit > 0
        align = (np.where(bits, 1, -1) * unit).sum(1) / np.sqrt(x.shape[1])
        return bits, norms, align

    def scores(self, query: np.ndarray, bits: np.ndarray, norms: np.ndarray, align: np.ndarray) -> np.ndarray:
        """Estimates of the inner products with a query."""
        q = self.turn @ query
        signs = np.where(bits, 1.0, -1.0) / np.sqrt(len(query))
        return norms * (signs @ q) / np.maximum(align, 1e-12) + query @ self.mean


#: Bits of a query's values where codes are one bit.
QUERY_BITS = 4


def hadamard(dims: int) -> np.ndarray:
    """An orthonormal rotation for a power of two: signs by the parity of the common bits of row and column, and of every third column's place."""
    i = np.arange(dims)
    return (1 - 2.0 * (np.bitwise_count(i[:, None] & i[None]) % 2)) * (1 - 2.0 * (i[None] % 3 == 0)) / np.sqrt(dims)


def one_bit_codes(vectors: DataFrame, quantizer: OneBitQuantizer, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, code, norm, align``: 64 signs a long; null vectors are left out."""

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                code, norm, align = quantizer.packed(to_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(code.view(np.int64)), pa.list_(pa.int64())), pa.array(norm), pa.array(align)], [key, "code", "norm", "align"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    return rows.mapInArrow(coded, f"{key} long, code array<long>, norm double, align double")


def one_bit_estimate(quantizer: OneBitQuantizer, query: np.ndarray) -> Column:
    """The estimated inner product of a code with one query, in the JVM: common bits with the query's planes are counted."""
    planes, low, step, total, shift = quantizer.planes(np.asarray(query, np.float64))
    ones = lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))
    common = [ones(F.zip_with("code", F.array(*[F.lit(int(w)) for w in plane.view(np.int64)]), lambda a, b: a.bitwiseAND(b))) for plane in planes]
    inner = low * ones(F.col("code")) + step * sum((c * (1 << j) for j, c in enumerate(common)), F.lit(0))
    return F.col("norm") * (2 * inner - total) / float(np.sqrt(len(query))) / F.greatest("align", F.lit(1e-12)) + shift


def one_bit_top_k(coded: DataFrame, vectors: DataFrame, query: np.ndarray, quantizer: OneBitQuantizer, k: int, widen: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best ``k`` vectors for one query: the ``widen * k`` best by codes, scored exactly."""
    near = coded.withColumn("_estimate", one_bit_estimate(quantizer, query)).orderBy(F.col("_estimate").desc(), key).limit(widen * k).select(key)
    exact = dot(vector, F.array(*[F.lit(float(x)) for x in query]))
    return vectors.join(near, key).select(key, exact.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


#: Bins in which estimates are counted, to find where a query's best end.
BINS = 256


def one_bit_batch_top_k(coded: DataFrame, vectors: DataFrame, queries: DataFrame, quantizer: OneBitQuantizer, k: int, widen: int = 20, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``query_id, vec_id, score, rank`` for a table of queries: blocks of codes and queries meet, the ``widen * k`` best of each query are scored exactly.

    However many those are, they are not handed on.  Where they end is found first: the range of a query's estimates, counts in ``BINS`` bins of it, and the
    last one's place in its bin.  Then each pair of blocks scores its own of them, and hands on ``k``.
    """
    most = widen * k
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(vector).alias("x"))
    codes = coded.select(key, F.struct("code", "norm", "align").alias(vector))

    def estimates(mine: pa.Table, theirs: pa.Table):
        """For each query of a block its row, its vector and the estimates of the other block."""
        own = theirs["vector"].combine_chunks()
        code = np.stack(own.field("code").to_numpy(zero_copy_only=False)).view(np.uint64) if len(own) else np.empty((0, 1), np.uint64)
        norm, align = (own.field(c).to_numpy() for c in ("norm", "align"))
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        rows = mine["vector"].combine_chunks()
        for row, x in zip(rows.to_pylist() if len(own) else [], to_matrix(rows.field("x")), strict=False):
            planes, low, step, total, shift = quantizer.planes(x)
            common = sum(np.bitwise_count(code & plane).sum(1, dtype=np.int64) << j for j, plane in enumerate(planes))
            yield row, x, norm * (2 * (low * ones + step * common) - total) / np.sqrt(len(x)) / np.maximum(align, 1e-12) + shift

    def over(known: DataFrame, held: DataFrame, work, schema: str) -> DataFrame:
        left = known.select("q", F.struct(*[c for c in known.columns if c != "q"]).alias(vector))
        return blocks.over_pairs(left, held, work, schema, ("q", key), vector)

    def table(rows: list, schema: str) -> pa.Table:
        kinds = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
        fields = [f.split(" ") for f in schema.split(", ")]
        return pa.table({name: pa.array([r[at] for r in rows], kinds[kind]) for at, (name, kind) in enumerate(fields)})

    def ends(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        keys = mine["key"].to_pylist()
        return table([(q, s.min(), s.max()) for q, (_, _, s) in zip(keys, estimates(mine, theirs), strict=False)], "q long, low double, high double")

    def bins(s: np.ndarray, row: dict) -> np.ndarray:
        width = row["high"] - row["low"]
        return np.clip(((row["high"] - s) * (BINS / width if width > 0 else 0.0)).astype(np.int64), 0, BINS - 1)

    def counted(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        keys = mine["key"].to_pylist()
        return table([(q, np.bincount(bins(s, r), minlength=BINS)) for q, (r, _, s) in zip(keys, estimates(mine, theirs), strict=False)], "q long, counts array<long>")

    def last_bin(parts: pa.Table) -> pa.Table:
        upto = np.cumsum(np.stack(parts["counts"].combine_chunks().to_numpy(zero_copy_only=False)).sum(0))
        at = min(int(np.searchsorted(upto, most)), BINS - 1)
        return table([(parts["q"][0].as_py(), at, min(most, int(upto[-1])) - (int(upto[at - 1]) if at else 0))], "q long, bin long, need long")

    def within(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        keys, held, found = mine["key"].to_pylist(), theirs["key"].to_numpy(), []
        for q, (r, _, s) in zip(keys, estimates(mine, theirs), strict=False):
            at = np.flatnonzero(bins(s, r) == r["bin"])
            found.append((np.full(len(at), q), held[at], s[at]))
        q, v, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": q, "v": v, "score": score})

    def scored(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        keys, held, found = mine["key"].to_pylist(), theirs["key"].to_numpy(), []
        m = to_matrix(theirs["vector"].combine_chunks().field("x"))
        for q, (r, x, s) in zip(keys, estimates(mine, theirs), strict=False):
            at = np.flatnonzero((s > r["cut"]) | ((s == r["cut"]) & (held <= r["until"])))
            if len(at) > k:
                near, margin = m[at] @ x, blocks.margins(x[None], m[at])[0]
                at = at[near >= -np.partition(-near, k - 1)[k - 1] - 2 * margin]
            score = blocks.exact_scores(m[at], np.broadcast_to(x, (len(at), len(x))))
            best = np.lexsort((held[at], -score))[:k]
            found.append((np.full(len(best), q), held[at[best]], score[best]))
        q, v, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": q, "v": v, "score": score})

    found = "q long, v long, score double"
    ranges = over(asked, codes, ends, "q long, low double, high double").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ranged = materialize(asked.join(ranges, "q"))
    last = over(ranged, codes, counted, "q long, counts array<long>").groupBy("q").applyInArrow(last_bin, "q long, bin long, need long")
    placed = materialize(ranged.join(last, "q"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "v")
    inside = over(placed, codes, within, found).withColumn("nth", F.row_number().over(order)).join(placed.select("q", "need"), "q")
    cuts = inside.filter("nth = need").select("q", F.col("score").alias("cut"), F.col("v").alias("until"))
    cut = materialize(placed.select("q", "x").join(cuts, "q"))
    whole = coded.join(vectors.select(key, F.col(vector).alias("x")), key).select(key, F.struct("code", "norm", "align", "x").alias(vector))
    best = materialize(over(cut, whole, scored, found))
    drop(ranged, placed, cut)
    return blocks.ranked(best, k, query_key, key)


class ChainQuantizer:
    """Additive codewords chosen by dynamic programming along a chain of codebooks.

    Each stage's choice costs its distance to its own target plus twice its inner product with the stage
    before, so the cheapest chain is found exactly by Viterbi's algorithm.
    """

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, np.float64)

    @classmethod
    def train(cls, sample: np.ndarray, stages: int, codes: int, rounds: int = 5, seed: int = 0) -> ChainQuantizer:
        rng = np.random.default_rng(seed)
        rest, books = sample.copy(), []
        for _ in range(stages):
            book = rest[rng.choice(len(rest), codes, replace=len(rest) < codes)].copy()
            for _ in range(8):
                own = ((rest[:, None] - book[None]) ** 2).sum(2).argmin(1)
                for c in range(codes):
                    if (own == c).any():
                        book[c] = rest[own == c].mean(0)
            rest = rest - book[((rest[:, None] - book[None]) ** 2).sum(2).argmin(1)]
            books.append(book)
        model = cls(np.stack(books))
        for _ in range(rounds):  # least squares over all codebooks at once, given the codes
            chosen = model.encode(sample)
            onehot = np.zeros((len(sample), stages * codes))
            onehot[np.arange(len(sample))[:, None], np.arange(stages)[None] * codes + chosen] = 1
            fitted = np.linalg.lstsq(onehot.T @ onehot + 1e-6 * np.eye(stages * codes), onehot.T @ sample, rcond=None)[0]
            model = cls(fitted.reshape(stages, codes, -1))
        return model

    def encode(self, x: np.ndarray) -> np.ndarray:
        stages, _, _ = self.books.shape
        own = (self.books**2).sum(2)[None] - 2 * np.einsum("nd,scd->nsc", x, self.books)
        cost, back = own[:, 0], []
        for s in range(1, stages):
            step = cost[:, :, None] + 2 * (self.books[s - 1] @ self.books[s].T)[None] + own[:, s, None, :]
            back.append(step.argmin(1))
            cost = step.min(1)
        codes = np.empty((len(x), stages), np.int64)
        codes[:, -1] = cost.argmin(1)
        for s in range(stages - 2, -1, -1):
            codes[:, s] = back[s][np.arange(len(x)), codes[:, s + 1]]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books))[None], codes].sum(1)


def reconstruction_error(coded: DataFrame, quantizer: ProductQuantizer, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean squared distance between vectors and what their codes decode to."""

    @F.pandas_udf("double")
    def error(x: pd.Series, codes: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        return pd.Series(((np.stack(x.to_numpy()) - quantizer.decode(np.stack(codes.to_numpy()))) ** 2).sum(1))

    return vectors.select(key, vector).join(coded, key).select(error(vector, "codes").alias("e")).agg(F.avg("e").alias("error"))


def sample_matrix(vectors: DataFrame, most: int = 50_000, seed: int = 0, vector: str = "embedding") -> np.ndarray:
    """About ``most`` vectors, chosen by a hash, in a fixed order."""
    total = max(1, vectors.count())
    part = F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1_000_003)) < min(1.0, most / total) * 1_000_003
    x = to_matrix(vectors.filter(part).select(vector).toArrow().column(0))
    return x[np.lexsort(x.T[::-1])]


def decoded_error(vectors: DataFrame, models: dict[str, Codec], vector: str = "embedding") -> DataFrame:
    """One row: ``n`` and, by model, the mean squared distance of all vectors that aren't null to what their codes decode to."""
    error = lambda model: over_rows(lambda m: ((m - model.decode(model.encode(m))) ** 2).sum(1), "double")(vector)
    far = vectors.filter(F.col(vector).isNotNull()).select(*[error(m).alias(k) for k, m in models.items()])
    return far.agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in models])


def one_bit_scores(vectors: DataFrame, model: OneBitQuantizer, query: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``estimate, exact`` inner products of every vector with a query, the first from its bits; null for a null vector."""
    estimate = over_rows(lambda x: model.scores(query, *model.encode(x)), "double")
    return vectors.select(estimate(vector).alias("estimate"), dot(vector, F.array(*[F.lit(float(v)) for v in query])).alias("exact"))


def codecs(sample: np.ndarray, subspaces: int, codes: int, seed: int = 0) -> dict[str, Codec]:
    """Our codecs at the same budget of codes, fitted on a bounded sample; the product ones code two groups of dimensions apart."""
    plain, turned = (train_pq(sample, subspaces, codes, seed=seed, rotate=r) for r in (False, True))
    groups = 2 if subspaces % 2 == 0 else 1
    additive_ones = {
        "rq": ResidualQuantizer.train(sample, subspaces, codes, seed=seed), "prq": product_of(ResidualQuantizer, sample, groups, subspaces // groups, codes, seed),
        "lsq": LocalSearchQuantizer.train(sample, subspaces, codes, seed=seed), "plsq": product_of(LocalSearchQuantizer, sample, groups, subspaces // groups, codes, seed),
    }
    return {"pq": plain, "opq": turned, "chain": ChainQuantizer.train(sample, subspaces, codes, 2, seed), **additive_ones}


def compared(sample: np.ndarray, subspaces: int, codes: int, seed: int = 0) -> dict[str, float]:
    """Reconstruction error of our codecs on the sample itself."""
    return {k: float(((sample - m.decode(m.encode(sample))) ** 2).sum(1).mean()) for k, m in codecs(sample, subspaces, codes, seed).items()}
