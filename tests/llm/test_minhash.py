"""The multi-index join against all pairs of full shingle sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def plain_report(rows):
    """Rows (id, text): n_shingles, component and kept of each, as a sorted list."""
    ids = [-(2**63) if i is None else i for i, _ in rows]
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for shingle in s:
            holders.setdefault(shingle, []).append(k)
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    back = lambda i: None if i == -(2**63) else i
    return sorted(((back(i), len(s), back(least[find(k)]), least[find(k)] == i) for k, (i, s) in enumerate(zip(ids, sets, strict=True))), key=str)


def got(docs, **options):
    g = minhash.near_groups(docs, **options) if options else None
    if g is not None:
        return sorted(((r.id, r.n, r.component, r.id == r.component) for r in g.collect()), key=str)
    return sorted(map(tuple, minhash.minhash_report(docs).collect()), key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice([[], [f"e{rng.randrange(99)}"]])
    return out


def corpus(seed, families=60):
    """Families of texts around the threshold: chains of edits, so that many pairs have similarities from 0.6 to 1."""
    rng, out = random.Random(seed), []
    for _ in range(families):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 5, 8, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            out.append((" " if rng.random() < 0.8 else "\n\t").join(words))
            words = edited(rng, words, max(1, int(len(words) * rng.choice([0.005, 0.02, 0.03, 0.05])))) or ["x"]
    rng.shuffle(out)
    return [(i, t.upper() if rng.random() < 0.1 else t) for i, t in enumerate(out)]


@pytest.mark.parametrize("options", [{}, {"chunk": 3}, {"chunk_bytes": 2_000}])
def test_components_equal_brute_force(spark, options):
    rows = corpus(4)
    want = plain_report(rows)
    assert len({r[2] for r in want}) < 0.8 * len(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), **options) == want


def test_components_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == plain_report([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_a_large_family_meets_in_chunks(spark, monkeypatch):
    """No member is near the centre of all, so that the rest must meet in pairs of chunks."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(edited(rng, words, 5))) for k in range(200)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), chunk=16) == plain_report(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A\tb  c"), (6, "a b c d"), (7, "x\x1cy z"), (None, "a b c d"), (None, None), (8, "word " * 20_000), (9, "word " * 4)]
    rows += [(10, "the same text of five words"), (10, "the same text of five words"), (10, "another text"), (11, "the same text of five words")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    for name in ("id", "key", "version", "n", "bucket", "component", "bytes", "sig"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert got(docs) == plain_report(rows)
    assert minhash.minhash_report(docs.limit(0)).count() == 0


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, minhash.CHUNKS * minhash.ROWS).astype(np.uint16)
    for _ in range(300):
        other = base.copy()
        at = rng.choice(len(base), minhash.DISTANCE, replace=False)
        other[at] += np.uint16(1)
        a, b = minhash.chunk_keys(base), minhash.chunk_keys(other)
        assert minhash.first_slots(base == other) == np.flatnonzero(a == b)[0]
    assert minhash.first_slots(base == base + np.uint16(1)) == -1
    assert minhash.beyond(0.8) < 1e-4 and minhash.beyond(0.85) < 1e-6


def test_symbols_differ_as_sets_do():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (800, 100, 100))
        shares.append((minhash.signature(np.unique(np.append(both, a))) != minhash.signature(np.unique(np.append(both, b)))).mean())
    assert abs(np.mean(shares) - 0.2) < 0.02
