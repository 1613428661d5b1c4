"""Preference networks: gradients against finite differences, norms, training and held-out pairs."""

import numpy as np
import pytest

from tessera.operators import networks


def loss(model, x1, x2, t, rows):
    """The members' summed cross entropies, a mean over channels."""
    p = model.chances(x1, x2)
    return -((t * np.log(p) + (1 - t) * np.log(1 - p)).mean(2) * rows).sum()


@pytest.mark.parametrize("hidden", [0, 1, 2])
def test_gradient_equals_finite_differences(hidden):
    rng = np.random.default_rng(1)
    model = networks.Ensemble.fresh(5, members=2, hidden=hidden, seed=3)
    x1, x2, t = rng.standard_normal((4, 5)), rng.standard_normal((4, 5)), rng.uniform(0.05, 0.95, (2, 4, 3))
    rows = rng.integers(0, 2, (2, 4)).astype(float)
    flat, g = model.flat(), model.gradient(x1, x2, t, rows).flat()
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        want = (loss(model.filled(flat + step), x1, x2, t, rows) - loss(model.filled(flat - step), x1, x2, t, rows)) / 2e-6
        assert g[k] == pytest.approx(want, abs=2e-8)


@pytest.mark.parametrize("hidden", [0, 1, 2])
def test_norms_equal_those_of_formed_gradients(hidden):
    rng = np.random.default_rng(2)
    model = networks.Ensemble.fresh(6, members=3, hidden=hidden, seed=4)
    x1, x2 = rng.standard_normal((7, 6)), rng.standard_normal((7, 6))
    got = model.gradient_norms(x1, x2)
    for k in range(7):
        g = model.gradient(x1[k : k + 1], x2[k : k + 1], np.full((3, 1, 3), 0.95))
        assert got[k] == pytest.approx(sum(np.linalg.norm(a[m]) for a in g.arrays for m in range(3)) / 3)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    x1, x2, w = rng.standard_normal((600, 8)), rng.standard_normal((600, 8)), rng.standard_normal((2, 8))
    p = 1 / (1 + np.exp(-2 * (x1 - x2) @ w.T))
    return spark.createDataFrame([(k, a.tolist(), b.tolist(), c.tolist()) for k, (a, b, c) in enumerate(zip(x1, x2, p, strict=True))], "id long, x1 array<double>, x2 array<double>, p array<double>")


def test_training_learns_and_repeats(pairs, monkeypatch):
    fresh = networks.Ensemble.fresh(8, members=3, channels=2)
    model = networks.train(pairs.filter("id >= 100"), fresh, epochs=6, batches=4, rate=0.02)
    again = networks.train(pairs.filter("id >= 100"), fresh, epochs=6, batches=4, rate=0.02)
    assert np.array_equal(model.flat(), again.flat())
    held = networks.judged(pairs.filter("id < 100"), model).collect()
    truth = {r.id: r.p for r in pairs.filter("id < 100").collect()}
    assert len(held) == 200 and np.mean([(r.chance > 0.5) == (truth[r.id][r.channel] > 0.5) for r in held]) > 0.9
    monkeypatch.setattr(networks, "SLICE", 10)  # the sums of each slice are added apart
    sliced = networks.train(pairs.filter("id >= 100"), fresh, epochs=1, batches=2)
    monkeypatch.undo()
    assert np.array_equal(sliced.flat(), networks.train(pairs.filter("id >= 100"), fresh, epochs=1, batches=2).flat())


def test_one_step_equals_the_whole_table_at_once(pairs):
    """A single batch: AdamW's first step goes by the sign of the mean gradient of all pairs."""
    fresh = networks.Ensemble.fresh(8, members=2, channels=2)
    rows = pairs.orderBy("id").collect()
    x1, x2, p = (np.array([r[c] for r in rows]) for c in ("x1", "x2", "p"))
    g = fresh.gradient(x1, x2, np.broadcast_to(p, (2, *p.shape))).flat() / len(rows)
    want = fresh.flat() - 0.01 * g / (np.abs(g) + 1e-8)
    assert np.allclose(networks.train(pairs, fresh, epochs=1, batches=1, rate=0.01).flat(), want, atol=1e-7)


def test_nulls_and_nothing(spark, pairs):
    odd = pairs.limit(3).unionByName(spark.createDataFrame([(1000, None, [0.0] * 8, [0.5, 0.5]), (None, [0.0] * 8, [0.0] * 8, [0.5, 0.5])], pairs.schema))
    model = networks.Ensemble.fresh(8, members=2, channels=2)
    assert networks.judged(odd, model).count() == 6
    assert np.array_equal(networks.train(pairs.limit(0), model, epochs=1, batches=1).flat(), model.flat())
    ab = odd.selectExpr("id AS a", "id + 1 AS b", "x1", "x2")
    assert [r.norm for r in networks.steep_pairs(ab, model, 2).collect()] == sorted((r.norm for r in networks.steep_pairs(ab, model, None).collect()), reverse=True)[:2]
