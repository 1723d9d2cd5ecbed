"""Networks fitted side by side: optimality, exact weights, seeds, validation, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimeweave.operators.networks import Network, fit_networks, macro_f1, predict_networks


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 400) > 0.3).astype(int) + (x[:, 2] > 1)
    weight = rng.integers(1, 4, 400)
    data = [(i, [float(v) for v in a], int(c), [float(w) if k == c else 0.0 for k in range(3)], "train" if i % 4 else "validation") for i, (a, c, w) in enumerate(zip(x, y, weight, strict=True))]
    data += [(900, None, 1, [0.0, 1.0, 0.0], "train"), (901, [1.0, 2.0, 3.0], 1, None, "train"), (902, [9.0, 9.0, 9.0], None, [0.0, 1.0, 0.0], "test")]
    return spark.createDataFrame(data, "id long, x array<double>, y int, mass array<double>, partition string").repartition(3)


def gradient_by_differences(net, flat, x, mass):
    out = np.zeros_like(flat)
    for j in range(len(flat)):
        step = np.zeros_like(flat)
        step[j] = 1e-6
        out[j] = (net.gradient(flat + step, x, mass)[0] - net.gradient(flat - step, x, mass)[0]) / 2e-6
    return out


def test_gradient():
    rng = np.random.default_rng(1)
    net = Network("n", "x", "m", 4, 3, (5, 2), seed=2)
    x, mass = rng.normal(size=(20, 4)), rng.uniform(size=(20, 3))
    flat = net.start()
    assert net.gradient(flat, x, mass)[1] == pytest.approx(gradient_by_differences(net, flat, x, mass), abs=1e-4)


def test_linear_fits_reach_the_optimum_from_every_seed(spark, rows):
    nets = [Network(f"s{s}", "x", "mass", 3, 3, seed=s, decay=1e-3) for s in range(3)]
    fitted = fit_networks(rows, nets, "partition = 'train'", steps=200, tolerance=1e-7)
    assert all(f.gradient <= 1e-7 and f.evaluations < 200 for f in fitted)
    assert fitted[0].params - fitted[0].params[-3:].mean() == pytest.approx(fitted[1].params - fitted[1].params[-3:].mean(), abs=0.2)
    assert fitted[0].loss == pytest.approx(fitted[2].loss, abs=1e-9)


def test_weights_are_exact(spark, rows):
    """A row of weight w counts as w rows, which a perceptron with two hidden layers sees in every gradient."""
    copies = rows.where("x is not null and mass is not null").withColumn("_n", F.array_max("mass").cast("int"))
    copies = copies.withColumn("_c", F.explode(F.sequence(F.lit(1), "_n"))).withColumn("mass", F.transform("mass", lambda m: F.signum(m)))
    net = [Network("n", "x", "mass", 3, 3, (8, 4), seed=5)]
    a, b = (fit_networks(d, net, "partition = 'train'", steps=8)[0] for d in (rows, copies))
    assert a.params == pytest.approx(b.params, abs=1e-9) and a.loss == pytest.approx(b.loss, abs=1e-12)


def test_validation_picks_the_best_step(spark, rows):
    nets = [Network("linear", "x", "mass", 3, 3), Network("mlp", "x", "mass", 3, 3, (16, 8), seed=1)]
    fitted = fit_networks(rows, nets, "partition = 'train'", "partition = 'validation'", "y", steps=60, patience=7)
    scored = predict_networks(rows.where("partition = 'validation'"), fitted).select("y", "probabilities").collect()
    for i, f in enumerate(fitted):
        cells = np.zeros((3, 3))
        for r in scored:
            cells[r.y, int(np.argmax(r.probabilities[i]))] += 1
        assert macro_f1(cells) == f.validation > 0.5
    assert fitted[1].validation > fitted[0].validation


def test_models_of_different_rows_and_columns(spark, rows):
    """Each model sees its own rows and features; together they equal fits of their own."""
    both = rows.withColumn("half", F.when(F.col("id") % 2 == 0, F.col("mass"))).withColumn("x2", F.slice("x", 1, 2))
    nets = [Network("all", "x", "mass", 3, 3), Network("half", "x2", "half", 2, 3, (4,), seed=9)]
    together = fit_networks(both, nets, "partition = 'train'", steps=12)
    for net, f in zip(nets, together, strict=True):
        alone = fit_networks(both.where("half is not null") if net.name == "half" else both, [net], "partition = 'train'", steps=12)[0]
        assert f.params == pytest.approx(alone.params, abs=1e-8)


def test_odd_rows(spark, rows):
    net = Network("n", "x", "mass", 3, 3)
    with pytest.raises(ValueError, match="no training rows"):
        fit_networks(rows.limit(0), [net], "true")
    fitted = fit_networks(rows, [net], "partition = 'train'", steps=5)
    got = {r.id: r.probabilities[0] for r in predict_networks(rows, fitted).collect()}
    assert got[900] is None and sum(got[901]) == pytest.approx(1.0) and len(got) == 403
    with pytest.raises(Exception, match="every array must hold 4 numbers"):
        fit_networks(rows, [Network("n", "x", "mass", 4, 3)], "partition = 'train'", steps=2)
