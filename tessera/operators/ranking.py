"""Preference data, score models and active learning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preference
from ..functions.vectors import over_rows, to_matrix
from .order import positions
from .search import batch_top_k
from .stats import ensemble


class ScoreModel:
    """``down @ silu(up @ x + bias)``, scaled by input over hidden width: an ensemble's mean, if wide."""

    def __init__(self, up: np.ndarray, bias: np.ndarray, down: np.ndarray):
        self.up, self.bias, self.down = (np.asarray(a, np.float64) for a in (up, bias, down))

    @classmethod
    def load(cls, path: str) -> ScoreModel:
        with np.load(path) as f:
            return cls(f["up_proj"], f["bias"], f["down_proj"])

    def save(self, path: str) -> None:
        np.savez(path, up_proj=self.up, bias=self.bias, down_proj=self.down)

    @classmethod
    def widen(cls, members: list[ScoreModel]) -> ScoreModel:
        """One wide model whose output is the members' mean."""
        return cls(np.vstack([m.up for m in members]), np.concatenate([m.bias for m in members]), np.hstack([m.down for m in members]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = x @ self.up.T + self.bias
        return (h / (1 + np.exp(-h))) @ self.down.T * (self.up.shape[1] / self.up.shape[0])


def scored(vectors: DataFrame, model: ScoreModel, vector: str = "embedding", to: str = "scores") -> DataFrame:
    """Add the model's outputs as an array, null for a null vector."""
    return vectors.withColumn(to, over_rows(model, "array<double>")(vector))


class SparseAutoencoder:
    """Encoder and decoder with top-k activation: ReLU, then only values above the k-th."""

    def __init__(self, up: np.ndarray, up_bias: np.ndarray, down: np.ndarray, down_bias: np.ndarray, k: int):
        self.up, self.up_bias, self.down, self.down_bias, self.k = up, up_bias, down, down_bias, k

    def features(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.down_bias) @ self.up.T + self.up_bias, 0)
        if self.k < h.shape[1]:
            limit = np.partition(h, -self.k - 1, axis=1)[:, -self.k - 1][:, None]
            h = np.where(h > limit, h, 0)
        return h

    def rebuild(self, features: np.ndarray) -> np.ndarray:
        return features @ self.down.T + self.down_bias


def feature_table(vectors: DataFrame, model: SparseAutoencoder, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, feature, value`` of active features only; a null vector has none."""

    def run(frames):
        for frame in frames:
            if len(frame):
                h = model.features(np.stack(frame[vector].to_numpy()).astype(np.float64))
                row, feature = np.nonzero(h)
                yield pd.DataFrame({key: frame[key].to_numpy()[row], "feature": feature, "value": h[row, feature]})

    return vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"{key} long, feature long, value double")


def feature_frequency(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def exemplars(features: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """The rows in which each feature is strongest."""
    w = Window.partitionBy("feature").orderBy(F.col("value").desc(), key)
    return features.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def signed_exemplars(vectors: DataFrame, directions: np.ndarray, n: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``direction, side, vec_id, score, rank``: the ``n`` vectors furthest along each direction (``max``) and against it (``min``).

    Directions are rows: components, or a decoder's features.  The score is the product with the signed direction;
    ties go to the smaller key, and null vectors are no exemplars.
    """
    both = [(2 * i + side, [float(v) for v in (row, -row)[side]]) for i, row in enumerate(directions) for side in (0, 1)]
    queries = vectors.sparkSession.createDataFrame(both, "query_id long, v array<double>").withColumnRenamed("v", vector)
    found = batch_top_k(vectors, queries, n, key, vector=vector)
    side = F.when(F.col("query_id") % 2 == 0, "max").otherwise("min")
    return found.select(F.expr("query_id div 2").alias("direction"), side.alias("side"), key, "score", "rank")


def covariance(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``i, j, cov`` for ``i <= j``; partial sums are combined before the shuffle."""
    def sums(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0))
                part = (len(x), x.sum(0), x.T @ x)
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            n, s, xx = total
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "n": np.full(len(i), n), "si": s[i], "sj": s[j], "sij": xx[i, j]})

    parts = vectors.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, "i long, j long, n long, si double, sj double, sij double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sij")])
    return t.select("i", "j", (F.col("sij") / F.col("n") - F.col("si") / F.col("n") * F.col("sj") / F.col("n")).alias("cov"))


def principal_components(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Components (rows; the largest entry is positive) and their shares of variance.

    What reaches the driver is dimensions squared, whatever the number of vectors.
    """
    rows = covariance(vectors, vector).toArrow()
    i, j, c = (rows.column(n).to_numpy() for n in ("i", "j", "cov"))
    m = np.zeros((i.max() + 1,) * 2)
    m[i, j] = m[j, i] = c
    values, columns = np.linalg.eigh(m)
    order = np.argsort(-values)[:k]
    parts = columns[:, order].T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    return parts, values[order] / values.sum()


def rated_pairs(ratings: DataFrame, files: DataFrame, key: str = "filename", vector: str = "embedding") -> DataFrame:
    """Ratings with the vectors of both sides."""
    side = lambda n: files.select(F.col(key).alias(f"meme{n}"), F.col(vector).alias(f"embedding{n}"))
    return ratings.join(side(1), "meme1").join(side(2), "meme2")


def unrated(candidates: DataFrame, rated: DataFrame) -> DataFrame:
    """Candidate pairs that nobody rated in either order."""
    done = rated.select("meme1", "meme2").union(rated.select(F.col("meme2"), F.col("meme1"))).distinct()
    return candidates.join(done, ["meme1", "meme2"], "left_anti")


def uncertain_pairs(pairs: DataFrame, scores: DataFrame, n: int = 50) -> DataFrame:
    """Pairs over whose preference an ensemble varies most.

    ``pairs`` has ``a, b``; ``scores`` has ``id, member, channel, score``.
    """
    side = lambda c, s: scores.select(F.col("id").alias(c), "member", "channel", F.col("score").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), ["b", "member", "channel"])
    both = both.withColumn("score", preference(F.col("sa"), F.col("sb")))
    spread = ensemble(both, "a", "b", "channel").groupBy("a", "b").agg(F.max("variance").alias("variance"))
    return spread.orderBy(F.col("variance").desc(), "a", "b").limit(n)


def random_pairs(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` random pairs ``a, b`` of rows, no row twice; keys and seed alone decide, so that every run has the same."""
    chance = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    placed = positions(df.select(F.col(key), chance.alias("_chance")), [F.col("_chance"), F.col(key)]).filter(F.col("place") < 2 * n)
    pairs = placed.withColumn("_pair", F.floor(F.col("place") / 2)).groupBy("_pair")
    both = pairs.agg(F.count(F.lit(1)).alias("_n"), F.min_by(key, "place").alias("a"), F.max_by(key, "place").alias("b"))
    return both.filter("_n = 2").select("a", "b")


def score_filter(scores: Column, limits: dict[int, float]) -> Column:
    """Whether any listed score is below its limit."""
    out = F.lit(False)
    for k, low in limits.items():
        out = out | (F.get(scores, k) < low)
    return out
