"""The pipeline's near copies against brute force over all pairs."""

import corpus_pipeline
import numpy as np

from tessera.llm import jaccard


def kept(texts, width=5, threshold=0.8):
    """The ids that are the smallest of their component, by comparing all pairs of sets of words."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids, similar = sorted(sets), []
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            either = len(sets[a] | sets[b])
            s = len(sets[a] & sets[b]) / either if either else 1.0
            if s >= threshold:
                similar.append(s)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k for k in ids if find(k) == k}, similar


def edited():
    """Texts, copies of them with a few words changed, and copies of copies: similarities from 0.6 to 1."""
    rng = np.random.default_rng(1)
    texts = {}
    for base in range(30):
        words = [f"w{n}" for n in rng.integers(0, 5_000, 150)]
        for _ in range(5):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for at in rng.choice(150, int(rng.integers(1, 6)), replace=False):
                words[at] = f"x{rng.integers(0, 10**9)}"
    order = rng.permutation(len(texts))
    texts = {int(k): texts[n] for n, k in enumerate(order)}
    return texts | {900: "", 901: None, 902: "Two Words", 903: "two words", 904: "two  other"}


def test_near_copies_are_those_of_jaccard(spark):
    texts = edited()
    want, similar = kept(texts)
    assert sum(s < 0.85 for s in similar) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == want


def test_chunks_lose_no_pair(spark):
    texts = edited()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for how in ({"chunk": 3}, {"chunk_bytes": 3_000}):
        assert {r.id for r in jaccard.near_groups(docs, **how).filter("id = component").collect()} == kept(texts)[0]


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == kept(texts)[0]


def test_close_fingerprints_meet_without_a_shared_band(spark, monkeypatch):
    import pyarrow as pa

    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(f"x{k}" for k in range(400))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    a, b, c = (jaccard.fingerprint(jaccard.shingles(t.encode())) for t in texts)
    assert (a ^ b).bit_count() <= 3 < (a ^ c).bit_count()
    signed = jaccard._signed

    def alone(batches, width):
        for batch in signed(batches, width):
            keys = batch.column("key").to_pylist()
            yield batch.set_column(3, "bands", pa.array([[k] for k in keys], pa.list_(pa.int64())))

    monkeypatch.setattr(jaccard, "_signed", alone)
    assert {r.id: r.component for r in jaccard.near_groups(docs).collect()} == {0: 0, 1: 0, 2: 2}
