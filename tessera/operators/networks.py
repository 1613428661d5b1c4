"""Preference models: an ensemble of small networks, trained on pairs and asked which pairs would move it most.

A network maps a vector to one score a channel through hidden layers with SiLU; the chance that the first of a pair is preferred is the
sigmoid of the difference of scores.  Arrays hold all members at once, so that an Arrow batch is a few matrix products.

Training is AdamW over mini-batches.  Each member has its own order of the pairs, by a hash of member, epoch and pair.  A step is
one job: tasks sum gradients over their Arrow batches, the sums of a slice of the parameters are added in one task each in the order of
partitions, and only the total, whose size is the model's, reaches the driver.  No pair does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import to_matrix

#: Parameters whose gradients are added in one task.
SLICE = 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ensemble:
    """``weights[l]`` is (members, outputs, inputs) and ``biases[l]`` (members, outputs); the last layer gives the scores."""

    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, dims: int, members: int = 16, hidden: int = 1, channels: int = 3, seed: int = 0) -> Ensemble:
        """Uniform values within one over the root of the inputs; hidden layers are as wide as the vectors."""
        rng = np.random.default_rng(seed)
        outs = [dims] * hidden + [channels]
        even = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(dims)
        return cls([even(members, n, dims) for n in outs], [even(members, n) for n in outs])

    @property
    def arrays(self) -> list[np.ndarray]:
        return [a for pair in zip(self.weights, self.biases, strict=True) for a in pair]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays])

    def filled(self, flat: np.ndarray) -> Ensemble:
        """The same shapes with other values."""
        parts = np.split(flat, np.cumsum([a.size for a in self.arrays])[:-1])
        shaped = [p.reshape(a.shape) for p, a in zip(parts, self.arrays, strict=True)]
        return Ensemble(shaped[::2], shaped[1::2])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Scores (members, rows, channels), and inputs and slopes of the layers."""
        a, inputs, slopes = np.broadcast_to(x, (len(self.weights[0]), *x.shape)), [], []
        for w, b in zip(self.weights[:-1], self.biases[:-1], strict=True):
            inputs.append(a)
            z = a @ w.transpose(0, 2, 1) + b[:, None]
            s = _sigmoid(z)
            slopes.append(s * (1 + z * (1 - s)))
            a = z * s
        inputs.append(a)
        return a @ self.weights[-1].transpose(0, 2, 1) + self.biases[-1][:, None], inputs, slopes

    def chances(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        """(members, rows, channels): chances that the first is preferred."""
        return _sigmoid(self.forward(x1)[0] - self.forward(x2)[0])

    def _deltas(self, x1: np.ndarray, x2: np.ndarray, target: np.ndarray, rows: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per layer from the last to the first: the inputs of both sides and the slopes of a row's loss by its outputs."""
        (s1, in1, up1), (s2, in2, up2) = self.forward(x1), self.forward(x2)
        d1 = (_sigmoid(s1 - s2) - target) / target.shape[-1]
        if rows is not None:
            d1 = d1 * rows[..., None]
        d2 = -d1
        for layer in range(len(self.weights) - 1, -1, -1):
            yield in1[layer], in2[layer], d1, d2
            if layer:
                d1, d2 = ((d @ self.weights[layer]) * up[layer - 1] for d, up in ((d1, up1), (d2, up2)))

    def gradient(self, x1: np.ndarray, x2: np.ndarray, target: np.ndarray, rows: np.ndarray | None = None) -> Ensemble:
        """Of the cross entropy, a mean over channels, summed over rows; ``rows`` (members, rows) weighs them."""
        weights, biases = [], []
        for a1, a2, d1, d2 in self._deltas(x1, x2, target, rows):
            weights.insert(0, d1.transpose(0, 2, 1) @ a1 + d2.transpose(0, 2, 1) @ a2)
            biases.insert(0, (d1 + d2).sum(1))
        return Ensemble(weights, biases)

    def gradient_norms(self, x1: np.ndarray, x2: np.ndarray, target: float = 0.95) -> np.ndarray:
        """Per row, the norms of the loss's gradient by each array of each member, summed; the loss is a mean over members and channels.

        A weight's gradient is a sum of two outer products, whose norm follows from the products of their factors; none is formed.
        """
        members, channels = self.biases[-1].shape
        total = np.zeros(len(x1))
        for a1, a2, d1, d2 in self._deltas(x1, x2, np.full((members, len(x1), channels), target), None):
            dots = lambda u, v: (u * v).sum(-1)
            square = dots(d1, d1) * dots(a1, a1) + dots(d2, d2) * dots(a2, a2) + 2 * dots(d1, d2) * dots(a1, a2)
            total += (np.sqrt(np.maximum(square, 0)) + np.linalg.norm(d1 + d2, axis=-1)).sum(0) / members
        return total


def _target(column: pa.Array, members: int) -> np.ndarray:
    """(members, rows, channels) of a column of arrays."""
    return np.broadcast_to(to_matrix(column), (members, len(column), len(column[0])))


def _gradients(pairs: DataFrame, model: Ensemble, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient sums of all members over ``mine, x1, x2, p``, and the number of pairs of each."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = None, np.zeros(members)
        for batch in batches:
            if batch.num_rows:
                mine, x1, x2 = (to_matrix(batch.column(c)) for c in range(3))
                part = model.gradient(x1, x2, _target(batch.column(3), members), mine.T).flat()
                total, counts = part if total is None else total + part, counts + mine.sum(0)
        if total is not None:
            total = np.concatenate((counts, total))
            for n, at in enumerate(range(0, len(total), SLICE)):
                yield pa.RecordBatch.from_pydict({"slice": pa.array([n], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([total[at : at + SLICE].tobytes()])})

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = sum(np.frombuffer(b) for b in rows["sums"].to_pylist())
        return pa.table({"slice": pa.array(rows["slice"][:1].to_pylist(), pa.int32()), "sums": pa.array([total.tobytes()])})

    found = pairs.mapInArrow(sums, "slice int, part int, sums binary").groupBy("slice").applyInArrow(added, "slice int, sums binary").orderBy("slice").collect()
    total = np.concatenate([np.frombuffer(r.sums) for r in found]) if found else np.zeros(members + model.flat().size)
    return total[members:], total[:members]


def train(pairs: DataFrame, model: Ensemble, epochs: int = 5, batches: int = 8, rate: float = 3e-4, decay: float = 0.0, seed: int = 0, key: str = "id", x1: str = "x1", x2: str = "x2", p: str = "p") -> Ensemble:
    """The ensemble after ``epochs`` times ``batches`` steps of AdamW; ``p`` is an array with a chance for each channel.

    ``pairs`` is read once a step, so it should be a written table; only the pairs of a step's mini-batches leave the scan.  Rows with a null are left out.
    """
    members = len(model.weights[0])
    pairs = pairs.select(key, x1, x2, p).dropna()
    flat, mean, square, step = model.flat(), 0.0, 0.0, 0
    owner = np.concatenate([np.repeat(np.arange(members), a.size // members) for a in model.arrays])
    for epoch in range(epochs):
        slot = F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), m, key), F.lit(batches)))  # noqa: B023
        for b in range(batches):
            mine = F.transform(slot, lambda s: (s == b).cast("double"))  # noqa: B023
            step += 1
            own = pairs.select(mine.alias("mine"), x1, x2, p).filter(F.exists("mine", lambda m: m > 0))
            total, counts = _gradients(own, model.filled(flat), members)
            g = total / np.maximum(counts, 1)[owner]
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            flat = flat * (1 - rate * decay) - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return model.filled(flat)


def judged(pairs: DataFrame, model: Ensemble, key: str = "id", x1: str = "x1", x2: str = "x2") -> DataFrame:
    """``id, channel, chance``: the ensemble's mean chance that the first of each pair is preferred; rows with a null are left out."""

    def chances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mean = model.chances(to_matrix(batch.column(1)), to_matrix(batch.column(2))).mean(0)
                n = mean.shape[1]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(np.repeat(np.arange(len(mean)), n))), "channel": pa.array(np.tile(np.arange(n, dtype=np.int32), len(mean))), "chance": mean.ravel()})

    return pairs.select(F.col(key).cast("long").alias("id"), x1, x2).dropna().mapInArrow(chances, "id long, channel int, chance double")


def steep_pairs(pairs: DataFrame, model: Ensemble, n: int | None = 50, target: float = 0.95, x1: str = "x1", x2: str = "x2") -> DataFrame:
    """The ``n`` pairs ``a, b`` with the largest ``norm``: how much the ensemble's parameters would move if the first were preferred; all with null."""

    def norms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                norm = model.gradient_norms(to_matrix(batch.column(2)), to_matrix(batch.column(3)), target)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norm)], ["a", "b", "norm"])

    out = pairs.select(F.col("a").cast("long"), F.col("b").cast("long"), x1, x2).dropna().mapInArrow(norms, "a long, b long, norm double")
    return out if n is None else out.orderBy(F.col("norm").desc(), "a", "b").limit(n)
