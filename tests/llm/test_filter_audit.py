"""The filter audit against plain loops over words, orders and documents."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_facts(text):
    words = text.encode().split()
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)]


def plain_audit(rows, labels):
    texts, first, out = {r[0]: r[1] or "" for r in rows}, {}, {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    fails = []
    for i, t, lang in rows:
        w, d, c, s, p = plain_facts(t or "")
        fails.append((i, lang or "", {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 3 * p, "D": s > 0, "E": i > first[t or ""]}))
    assert texts
    for part in {f[1] for f in fails}:
        own = [f for f in fails if f[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[2][letter]]
                rest = [f for f in left if not f[2][letter]]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(rest), len(gone), sum(f[2][letter] for f in own) - len(gone), sum(f[2][letter] and sum(f[2].values()) == 1 for f in own),
                    sum(f[0] in good for f in gone), sum(f[0] in toxic for f in gone), letter,
                ]
                left = rest
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]]
    return out


def got_audit(docs, labels):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in filter_audit.audit_report(docs, labels).collect()}


def odd_texts():
    rng = random.Random(3)
    some = ["", " \n\t", "A", "é ü 漢字 漢字 漢字", "x\x1cy x y", "#", "$ % & * |", "w" * 63 + " " + "w" * 64 + " " + "w" * 65 + " " + "w" * 64, "\x0b\x0c a\r\nb ", "HELLO world"]
    some += [" ".join(rng.choice(["a", "B", "longer", "x" * rng.randrange(1, 90), "ü"]) for _ in range(rng.randrange(500))) for _ in range(40)]
    return some


@pytest.mark.parametrize("block", [1, 40, 3000, 1 << 20])
def test_scan_equals_plain_counts(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    texts = odd_texts()
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before", *texts], kind).slice(1)
        assert filter_audit.scan(*filter_audit.buffer_of(column)).tolist() == [plain_facts(t) for t in texts]
    assert filter_audit.scan(*filter_audit.buffer_of(pa.array(["", ""]))).tolist() == [[0] * 5] * 2


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_equal_hashes_are_told_apart(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    monkeypatch.setattr(filter_audit, "word_hashes", lambda padded, starts, lengths: np.zeros(len(starts), np.uint64))
    texts = odd_texts()
    assert filter_audit.scan(*filter_audit.buffer_of(pa.array(texts))).tolist() == [plain_facts(t) for t in texts]


def test_audit_equals_all_orders(spark):
    rng = random.Random(5)
    texts = ["", None, "few words", *[" ".join(rng.choice(["alpha", "beta", "GAMMA", "d%", str(rng.randrange(300))]) for _ in range(rng.randrange(150, 260))) for _ in range(6)]]
    texts += [" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randrange(190, 260))) for _ in range(4)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(300)]
    rows += [(7, "few words", "en"), (7, "few words", "en"), (8, "another", "en")]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS)
    for name in ("id", "part", "mask", "n", "digest", "words", "quality", "toxic"):
        docs = docs.withColumn(name, docs.source)
    got = got_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == plain_audit(rows, labels)


def test_audit_of_nulls_and_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "a", None, None, None), (3, None, "x", None, None)], DOCS)
    got = got_audit(docs, labels)
    # the row without an id has the smallest, so the other empty text is its copy
    assert got["", "ABCDE", 1] == [0, 2, 0, 2, 0, 0, 240] and got["x", "EABCD", 1] == [0, 1, 0, 0, 0, 0, 60]
    assert filter_audit.audit_report(docs.limit(0), labels).count() == 0


def test_digest_is_of_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "x " * 200_000, "en", "s", 0)], DOCS)
    r = filter_audit.text_facts(docs).first()
    assert bytes(r.digest).hex() == hashlib.sha256(b"x " * 200_000).hexdigest() and [r[f] for f in filter_audit.FACTS] == [200_000, 1, 0, 0, 400_000]
