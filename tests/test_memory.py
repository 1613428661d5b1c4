"""What a task holds is bounded, whatever its block."""

import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm import language_id, packing
from tessera.operators import blocks, dedup


def peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def unit(n, dims=64, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_best_k_of_a_block_is_held_in_tiles():
    x, q = unit(blocks.BLOCK_ROWS), unit(2_000, seed=1)
    x[4_000:4_300], q[7] = x[0], 0  # copies of one vector, and a query that ties with all
    (i, v, score), mb = peak(lambda: blocks.best_k(q, np.arange(len(q)), x, np.arange(len(x)), 20))
    assert mb < 250
    assert v[i == 7].tolist() == list(range(20))
    for at in range(0, len(q), 97):
        exact = blocks.exact_scores(np.repeat(q[at : at + 1], len(x), 0), x)
        want = np.lexsort((np.arange(len(x)), -exact))[:20]
        assert v[i == at].tolist() == want.tolist() and score[i == at].tolist() == exact[want].tolist()


def test_links_of_a_block_are_held_in_tiles():
    x, y = unit(4_096), unit(4_096, seed=1)
    near, mb = peak(lambda: dedup.near_blocks(np.arange(4_096), x, np.arange(4_096), y, 0.45))
    assert mb < 120
    (rows, columns), mb = peak(lambda: dedup._block_links(near))
    assert mb < 60
    reach = np.where(near, columns[None], near.shape[1]).min(1)
    assert (reach == rows).all() and all((columns[near[r]] == rows[r]).all() for r in range(len(near)))


def test_one_bit_search_hands_on_only_the_best(spark, monkeypatch):
    from tessera.operators import quantize

    x = unit(400, 16).astype(np.float32)
    x[350:] = x[7]  # copies tie by estimate and by score
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    model = quantize.OneBitQuantizer(x[:300].mean(0), turn=quantize.hadamard(16))
    asked = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    ranked, sent = blocks.ranked, []
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    monkeypatch.setattr(blocks, "ranked", lambda found, *how: (sent.append(found.count()), ranked(found, *how))[1])
    got = {}
    for r in quantize.one_bit_batch_top_k(quantize.one_bit_codes(v, model), v, asked, model, 5, widen=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert max(sent) <= 8 * 4 * 5
    code, norm, align = model.packed(x.astype(np.float64))
    for q, found in got.items():
        query = x[q].astype(np.float64)
        planes, low, step, total, shift = model.planes(query)
        common = sum(np.bitwise_count(code & p).sum(1, dtype=np.int64) << j for j, p in enumerate(planes))
        near = norm * (2 * (low * np.bitwise_count(code).sum(1, dtype=np.int64) + step * common) - total) / 4 / np.maximum(align, 1e-12) + shift
        chosen = np.lexsort((np.arange(400), -near))[:80]
        exact = blocks.exact_scores(x[chosen].astype(np.float64), np.broadcast_to(query, (80, 16)))
        assert [found[k] for k in range(1, 6)] == chosen[np.lexsort((chosen, -exact))[:5]].tolist()
    assert len(got) == 8


def test_a_worker_gives_back_what_arrow_freed():
    """In a process of its own, whose anonymous memory counts no other test's."""
    code = """if True:
        import re
        import pyarrow as pa
        from tessera.llm.common import slices

        def batches():
            for k in range(8):
                yield pa.record_batch({"text": pa.array([f"{k:08}" * (200 + 100 * k)] * 5_000)})

        held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
        before = held()
        for batch in slices(batches()):
            del batch
        print(held() - before)
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=root)
    assert int(out.stdout) < 60


def test_language_stage_sends_each_text_to_python_once(spark):
    rows = [(k, f"{'the cat sat on' if k % 2 else 'der hund lief im'} {k} " * 500, "en" if k % 2 else "de", "web") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = language_id.language_stage(docs)
    assert {(r.doc_id, r.text, r.lang) for r in told.collect()} == {r[:3] for r in rows}
    node, sent = told._jdf.queryExecution().executedPlan(), []
    while True:
        if node.metrics().contains("pythonDataSent"):
            sent.append(node.metrics().apply("pythonDataSent").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        elif node.children().isEmpty():
            break
        else:
            node = node.children().head()
    size = sum(len(r[1]) for r in rows)
    assert len(sent) == 1 and size < sent[0] < 1.1 * size


def test_a_tokenizer_forgets_the_texts_of_its_task():
    path = packing.default_tokenizer()
    run, batch = packing._pieces(path, packing.LENGTH), pa.record_batch({"id": range(100), "text": [" ".join(f"a{k * 1_000 + j}b" for j in range(1_000)) for k in range(100)]})
    packing.tokens(path)
    tracemalloc.start()
    try:
        once, again = ([o.to_pydict() for o in run([batch])] for _ in range(2))
        assert once == again
        del once, again
        assert tracemalloc.get_traced_memory()[0] < 2e6
    finally:
        tracemalloc.stop()
