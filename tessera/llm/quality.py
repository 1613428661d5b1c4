"""Quality classifier from weak labels.

``LABELLERS`` overlapping heuristics vote good, bad or nothing on every whole text.
Expectation-maximisation over the counts of all vote patterns (at most ``3 ** len(LABELLERS)``, however
many documents) estimates each labeller's accuracy and the posterior of each
pattern.  Labellers that look at the same fault agree beyond chance, so bad texts may be of several kinds, each with
its own rates of votes: models of one to ``KINDS`` classes are fitted, and the Bayesian information criterion
chooses.  A class is bad if some labeller calls most of it bad.  No rate is set by hand.
The posteriors label a bounded sample of about ``SAMPLE`` documents, on which a
linear scorer over hashed words and word shapes is trained; it scores every document.

Defined results.  A null or empty text has no words: every labeller abstains, and the scorer sees only
its bias.  A null id is the smallest id.  Rows that repeat an id are scored on their own; equal texts get equal scores.
A very long text is read whole.  A score of exactly one half is kept.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, give_back, lift, materialize, slices, spread, whole

BITS = 14
SAMPLE = 4_000
MEASURE = 0.4
#: The most classes of texts that the label model tells apart.
KINDS = 7
_WORDS = 200_000
_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?")
_CAPITALS, _SMALL, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))


_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


class Facts:
    """What the labellers look at, from one pass over a text in UTF-8."""

    def __init__(self, text: bytes):
        words = text.split()
        self.words = Counter(words)
        size = max(1, len(text))
        self.n = len(words)
        count = lambda some: len(text) - len(text.translate(None, some))
        self.signs = count(_SIGNS) / size
        capitals = count(_CAPITALS)
        self.capitals = capitals / max(1, capitals + count(_SMALL))
        self.digits = count(_DIGITS) / size
        often = self.words
        self.distinct = len(often) / max(1, self.n)
        self.echo = sum(map(operator.eq, words, words[1:])) / max(1, self.n)
        self.top = max(often.values(), default=0) / max(1, self.n)
        self.lone_signs = sum(n for w, n in often.items() if len(w) == 1 and not w.isalnum()) / max(1, self.n)
        self.length = sum(len(w) * n for w, n in often.items()) / max(1, self.n)
        self.short = sum(n for w, n in often.items() if len(w) <= 3 and w.isalpha()) / max(1, self.n)
        ends = [x.rstrip()[-1:] for x in text.split(b"\n") if x.strip()]
        self.sentences = sum(e in b".!?" for e in ends) / max(1, len(ends))


def _vote(good: bool, bad: bool) -> int:
    return 2 if bad else 1 if good else 0


#: Each gives 0 for no vote, 1 for good, 2 for bad.
LABELLERS: list[tuple[str, Callable[[Facts], int]]] = [
    ("signs", lambda f: _vote(f.signs < 0.01, f.signs > 0.05)),
    ("capitals", lambda f: _vote(f.capitals < 0.15, f.capitals > 0.5)),
    ("lone signs", lambda f: _vote(f.lone_signs == 0, f.lone_signs > 0.08)),
    ("repeated word", lambda f: _vote(f.n >= 20 and f.top < 0.15, f.n >= 20 and f.top > 0.3)),
    ("distinct words", lambda f: _vote(f.n >= 20 and f.distinct > 0.3, f.n >= 50 and f.distinct < 0.12)),
    ("echo", lambda f: _vote(f.n >= 20 and f.echo < 0.15, f.n >= 20 and f.echo > 0.3)),
    ("word length", lambda f: _vote(3 <= f.length <= 9, not 2 <= f.length <= 15)),
    ("short words", lambda f: _vote(f.short > 0.12, f.n >= 20 and f.short < 0.02)),
    ("sentences", lambda f: _vote(f.sentences > 0.6, f.n >= 20 and f.sentences < 0.1)),
    ("digits", lambda f: _vote(f.digits < 0.05, f.digits > 0.25)),
]


def pattern(facts: Facts) -> int:
    """All votes as a number to the base 3."""
    out = 0
    for _, labeller in LABELLERS:
        out = out * 3 + (labeller(facts) if facts.n else 0)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """(patterns, labellers) of votes."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // powers % 3


class LabelModel:
    """Posterior of good for vote patterns, and the labellers' accuracies.

    Given its class, a text's votes are independent; an abstention says nothing.  ``rates`` has, for each class
    and labeller, the share of bad among the votes cast.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 1000):
        self.patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[int(p)] for p in self.patterns], float)
        votes = votes_of(self.patterns)
        best = np.inf
        for kinds in range(1, KINDS + 1):
            belief, share, rates, likelihood = _fit(votes, n, _start(votes, n, kinds), rounds)
            criterion = (kinds * (votes.shape[1] + 1) - 1) * np.log(max(1.0, n.sum())) - 2 * likelihood
            if criterion < best:
                best, self.belief, self.share, self.rates = criterion, belief, share, rates
        self.bad = (self.rates > 0.5).any(1)
        self.posterior = dict(zip(self.patterns.tolist(), self.belief[:, ~self.bad].sum(1).tolist(), strict=True))
        self.prior = float(self.share[~self.bad].sum())
        # of the votes cast, the share that agrees with the truth, by the model's own belief
        hit = self.share @ np.where(self.bad[:, None], self.rates, 1 - self.rates)
        self.accuracy = {name: float(a) for (name, _), a in zip(LABELLERS, hit, strict=True)}


def _start(votes: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """First beliefs (patterns, classes): a class without bad votes, and classes around frequent, far-apart sets of them."""
    bad = (votes == 2).astype(float)
    sets, where = np.unique(bad, axis=0, return_inverse=True)
    often = np.bincount(where.ravel(), n, len(sets))
    seeds = [np.zeros(votes.shape[1])]
    while len(seeds) < kinds and len(sets):
        apart = np.abs(sets[:, None] - np.array(seeds)[None]).sum(2).min(1)
        seeds.append(sets[(often * apart).argmax()])
    far = np.abs(bad[:, None] - np.array(seeds)[None]).sum(2)
    near = np.exp(-2 * (far - far.min(1, keepdims=True)))
    return near / near.sum(1, keepdims=True)


def _fit(votes: np.ndarray, n: np.ndarray, belief: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: beliefs, shares of classes, rates of bad votes, and the log likelihood."""
    cast, bad = (votes > 0).astype(float), (votes == 2).astype(float)
    before = -np.inf
    for _ in range(rounds):
        weight = n[:, None] * belief
        share = (weight.sum(0) + 1) / (weight.sum() + belief.shape[1])
        rates = (weight.T @ bad + 1) / (weight.T @ cast + 2)
        joint = np.log(share) + bad @ np.log(rates).T + (cast - bad) @ np.log1p(-rates).T
        top = joint.max(1, keepdims=True, initial=-np.inf)
        each = np.exp(joint - top)
        whole_ = each.sum(1, keepdims=True)
        likelihood = float((n * (top + np.log(whole_))[:, 0]).sum())
        belief = each / whole_
        if likelihood - before < 1e-7 * abs(likelihood):
            break
        before = likelihood
    return belief, share, rates, likelihood


class Hasher:
    """Hashed words, word shapes and rounded measures of a text: places and weights.

    Words and shapes make a unit vector; each measure adds one place of weight ``MEASURE``.
    """

    def __init__(self) -> None:
        self._seen: dict[bytes, int] = {}

    def _places(self, word: bytes) -> int:
        """The places of the word and of its shape, in one number."""
        shape = (word[:3] + word[-3:]).translate(_SHAPES)
        mask = (1 << BITS) - 1
        if len(self._seen) >= _WORDS:
            self._seen.clear()
        self._seen[word] = out = (xxhash.xxh32_intdigest(word.lower(), 1) & mask) << BITS | xxhash.xxh32_intdigest(shape, 2) & mask
        return out

    def __call__(self, facts: Facts) -> tuple[np.ndarray, np.ndarray]:
        seen, fresh = self._seen.get, self._places
        both = np.array([seen(w) or fresh(w) for w in facts.words], np.int64)
        n = np.fromiter(facts.words.values(), np.float64, len(both))
        counts = np.bincount(both >> BITS, n, 1 << BITS) + np.bincount(both & ((1 << BITS) - 1), n, 1 << BITS)
        at = np.flatnonzero(counts)
        x = np.sqrt(counts[at])
        measures = (facts.signs, facts.capitals, facts.lone_signs, facts.top, facts.echo, facts.distinct, facts.short, facts.sentences, facts.digits, min(1.0, facts.n / 100))
        named = [xxhash.xxh32_intdigest(b"%d:%d" % (k, round(10 * m)), 3) & ((1 << BITS) - 1) for k, m in enumerate(measures)]
        return np.append(at, named), np.append(x / max(1e-9, np.sqrt((x * x).sum())), [MEASURE] * len(named))


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 200, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for posterior labels, by accelerated gradient descent."""
    w = np.zeros((1 << BITS) + 1)
    if not rows:
        return w
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([x for _, x in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    weight = np.full(len(rows), 1 / len(rows))
    v = w.copy()
    for k in range(rounds):
        score = np.bincount(row, x * v[at], len(rows)) + v[-1]
        slope = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
        new = v - rate * np.append(np.bincount(at, x * slope[row], 1 << BITS) + decay * v[:-1], slope.sum())
        v, w = new + k / (k + 3) * (new - w), new
    return w


def quality_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, posterior, score, kept`` of each document; ``kept`` where the scorer finds good at least as likely as bad."""
    total = docs.count()
    d = docs.select(lift("doc_id").alias("id"), whole("text").alias("text")).withColumn("h", F.xxhash64(F.lit("sample"), "id", "text"))
    d = spread(d.select("id", F.col("text").cast("binary").alias("text"), "h"))
    # the rows with the smallest hashes; half as many again are read, so that there are enough
    limit = int(min(1.0, 1.5 * sample / max(1, total)) * 2.0**64 - 2**63) - 1

    def vote(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, schema = Hasher(), pa.schema([("pattern", pa.int64()), ("h", pa.int64()), ("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))])
        for batch in slices(batches):
            rows = []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                facts = Facts(text)
                at, x = hasher(facts) if h <= limit else (None, None)
                rows.append({"pattern": pattern(facts), "h": h, "at": at, "x": x})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    voted = materialize(d.select("text", "h").mapInArrow(vote, "pattern long, h long, at array<long>, x array<double>"))
    model = LabelModel(dict(voted.groupBy("pattern").agg(F.count(F.lit(1))).collect()))
    got = voted.filter("at IS NOT NULL").toArrow()
    patterns, hashes = got.column("pattern").to_pylist(), got.column("h").to_pylist()
    order = sorted(range(got.num_rows), key=lambda k: (hashes[k], patterns[k]))[:sample]  # rows arrive in any order
    rows = [(got.column("at")[k].values.to_numpy(), got.column("x")[k].values.to_numpy()) for k in order]
    posterior = model.posterior
    weights = train_scorer(rows, np.array([posterior[patterns[k]] for k in order]))
    drop(voted)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches):
            q, raw = [], []
            for facts in map(Facts, batch.column(1).to_pylist()):
                at, x = hasher(facts)
                q.append(posterior[pattern(facts)])
                raw.append(float(x @ weights[at]) + weights[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw), -30, 30))), pa.float64())], ["id", "posterior", "score"])

    out = d.select("id", "text").mapInArrow(score, "id long, posterior double, score double")
    return out.select(give_back(F.col("id")).alias("doc_id"), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
