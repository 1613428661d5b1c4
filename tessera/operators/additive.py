"""Additive codecs: a vector is coded as a sum of codewords, one from each book.

Residual codes are found book by book with a beam of partial sums; product-residual codes do so within groups of dimensions; local-search codes
start from residual ones and change one codeword at a time while that helps, with random kicks.  Books are fitted on a bounded sample of the
caller's; ``encode`` and ``decode`` are for batches of any vectors, in tasks.
"""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, codes: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Means of a sample's clusters; a cluster without members gets the farthest vector."""
    book = x[rng.choice(len(x), codes, replace=len(x) < codes)].astype(np.float64)
    for _ in range(rounds):
        far = (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)
        own = far.argmin(1)
        sums, n = np.zeros_like(book), np.bincount(own, minlength=codes)
        np.add.at(sums, own, x)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[far.min(1).argmax()])
    return book


class Additive:
    """``books`` is (books, codes, dimensions)."""

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, np.float64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes].sum(1)

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((x - self.decode(codes)) ** 2).sum(1)

    def refitted(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The books of least squared error for given codes of a sample."""
        m, c, d = self.books.shape
        flat = np.arange(m) * c + codes
        counts = np.zeros((m * c, m * c))
        np.add.at(counts, (flat[:, :, None], flat[:, None, :]), 1.0)
        sums = np.zeros((m * c, d))
        for book in range(m):
            np.add.at(sums, flat[:, book], x)
        ridge = 1e-6 * len(x) / c * np.eye(m * c)
        return np.linalg.solve(counts + ridge, sums + ridge @ self.books.reshape(m * c, d)).reshape(m, c, d)


class ResidualQuantizer(Additive):
    """Each book codes what the books before leave; ``beam`` partial sums are kept."""

    def __init__(self, books: np.ndarray, beam: int = 8):
        super().__init__(books)
        self.beam = beam

    @classmethod
    def train(cls, sample: np.ndarray, books: int, codes: int, beam: int = 8, seed: int = 0) -> ResidualQuantizer:
        rng, rest, out = np.random.default_rng(seed), np.asarray(sample, np.float64), []
        for _ in range(books):
            out.append(kmeans(rest, codes, rng))
            model = cls(np.stack(out), beam)
            rest = sample - model.decode(model.encode(sample))
        return cls(np.stack(out), beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        rest, path = x[:, None, :], np.zeros((n, 1, 0), np.int64)
        for book in self.books:
            far = (rest * rest).sum(2)[..., None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = far.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
            at, code = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, at[..., None], 1) - book[code]
            path = np.concatenate((np.take_along_axis(path, at[..., None], 1), code[..., None]), 2)
        return path[np.arange(n), (rest * rest).sum(2).argmin(1)]


class ProductAdditive:
    """An additive codec of its own for each group of dimensions."""

    def __init__(self, parts: list[Additive]):
        self.parts = parts
        self.cuts = np.cumsum([p.books.shape[2] for p in parts])[:-1]
        self.ends = np.cumsum([len(p.books) for p in parts])[:-1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([p.encode(c) for p, c in zip(self.parts, np.split(x, self.cuts, 1), strict=True)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([p.decode(c) for p, c in zip(self.parts, np.split(codes, self.ends, 1), strict=True)], 1)


class LocalSearchQuantizer(Additive):
    """Codes from which no change of one codeword helps, the best after ``kicks`` disturbed searches.

    Training goes to and fro between codes and books of least error.  Every step is a fixed rule of model and vector, so a vector has the same code in
    every batch.
    """

    def __init__(self, books: np.ndarray, kicks: int = 4, beam: int = 4, seed: int = 0):
        super().__init__(books)
        self.kicks, self.beam, self.seed = kicks, beam, seed

    @classmethod
    def train(cls, sample: np.ndarray, books: int, codes: int, rounds: int = 4, seed: int = 0) -> LocalSearchQuantizer:
        model = cls(ResidualQuantizer.train(sample, books, codes, seed=seed).books, seed=seed)
        for _ in range(rounds):
            model = cls(model.refitted(sample, model.encode(sample)), seed=seed)
        return model

    def _descended(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Codewords changed in turn, each to the best given the others, until none changes."""
        codes, moving = codes.copy(), np.arange(len(x))
        while len(moving):
            before = codes[moving].copy()
            rest = x[moving] - self.decode(before)
            for m, book in enumerate(self.books):
                target = rest + book[codes[moving, m]]
                far = (book * book).sum(1) - 2 * target @ book.T
                old = far[np.arange(len(moving)), codes[moving, m]]
                best = far.argmin(1)
                new = np.where(far[np.arange(len(moving)), best] < old - 1e-12, best, codes[moving, m])
                rest = target - book[new]
                codes[moving, m] = new
            moving = moving[(codes[moving] != before).any(1)]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        m, c, _ = self.books.shape
        best = self._descended(x, ResidualQuantizer(self.books, self.beam).encode(x))
        least, rng = self.errors(x, best), np.random.default_rng(self.seed)
        for _ in range(self.kicks):
            # the same kick for every vector, so that batches don't matter
            where, by = rng.choice(m, max(1, m // 4), replace=False), rng.integers(1, c, max(1, m // 4)) if c > 1 else 0
            kicked = best.copy()
            kicked[:, where] = (kicked[:, where] + by) % c
            kicked = self._descended(x, kicked)
            errors = self.errors(x, kicked)
            better = errors < least - 1e-12
            best[better], least = kicked[better], np.where(better, errors, least)
        return best


def product_of(kind: type[Additive], sample: np.ndarray, groups: int, books: int, codes: int, seed: int = 0) -> ProductAdditive:
    """``groups`` groups of dimensions with ``books`` books each."""
    return ProductAdditive([kind.train(part, books, codes, seed=seed + k) for k, part in enumerate(np.array_split(np.asarray(sample, np.float64), groups, axis=1))])
