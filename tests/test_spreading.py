"""Kernels, tiles and spread sums against plain sums."""

import math

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators import nonuniform as N
from tessera.operators import spreading


def _points(rng, n, d, hot=0):
    x = rng.uniform(-3, 5, (n, d))
    x[:hot] = x[0]
    return x, rng.normal(size=n), rng.normal(size=n)


def _frame(spark, x, re, im):
    d = x.shape[1]
    rows = [(i, *map(float, x[i]), float(re[i]), float(im[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "pid long, " + ", ".join(f"x{k} double" for k in range(d)) + ", re double, im double").repartition(3)


def _modes(shape):
    return np.stack(np.meshgrid(*[np.arange(n) - n // 2 for n in shape], indexing="ij"), -1).reshape(-1, len(shape))


@pytest.mark.parametrize("epsilon", [1e-2, 1e-4, 1e-6, 1e-8, 1e-10, 1e-12])
@pytest.mark.parametrize("sigma", [1.5, 2.0])
def test_kernels_meet_the_accuracy_they_are_chosen_for(epsilon, sigma):
    """One-dimensional sums on a grid in plain NumPy, at places that have nothing to do with those of the measurement."""
    try:
        kernel = kernels.for_accuracy(epsilon, 1, sigma)
    except ValueError:
        assert epsilon < kernels.best_epsilon(1, sigma_min=sigma, sigma_max=sigma)
        return
    n, fine, rng = 30, int(30 * sigma), np.random.default_rng(1)
    x, c = rng.uniform(0, 1, 200), rng.normal(size=200) + 1j * rng.normal(size=200)
    grid = np.zeros(fine, complex)
    for p, v in zip(x * fine, c, strict=True):
        cells = math.ceil(p - kernel.width / 2) + np.arange(kernel.width)
        np.add.at(grid, cells % fine, v * kernel.weights(cells - p))
    k = np.arange(n) - n // 2
    found = np.fft.fft(grid)[k % fine] / kernel.transform(k / fine)
    exact = np.exp(-2j * np.pi * np.outer(k, x)) @ c
    assert np.linalg.norm(found - exact) <= epsilon * np.linalg.norm(exact)


def test_best_epsilon_and_choice():
    assert kernels.best_epsilon(1) < 1e-13 and kernels.best_epsilon(3) < 1e-12
    assert kernels.best_epsilon(2, singleprec=True) > 1e-8
    with pytest.raises(ValueError):
        kernels.chosen(1e-16, [10], 10)
    with pytest.raises(ValueError):
        kernels.chosen(1e-6, [10], 10, 1.0, 2.0)
    assert kernels.chosen(1e-6, [1000], 1e9, 1.2, 2.5).width <= kernels.chosen(1e-6, [1000], 1.0, 1.2, 2.5).width


@pytest.mark.parametrize("shape,epsilon", [((41,), 1e-9), ((1001,), 1e-11), ((12, 9), 1e-9), ((7, 6, 5), 1e-9), ((40, 30), 1e-5)])
def test_spread_sums_equal_plain_sums(spark, monkeypatch, shape, epsilon):
    """Both directions over several tiles, with a third of the points at one place, to the accuracy asked for."""
    monkeypatch.setattr(spreading, "SIDES", {1: 256, 2: 20, 3: 16})
    monkeypatch.setattr(spreading, "MOST_POINTS", 60)
    rng, axes = np.random.default_rng(len(shape)), [f"k{i}" for i in range(len(shape))]
    x, re, im = _points(rng, 300, len(shape), hot=100)
    points, coords, held = _frame(spark, x, re, im), [f"x{k}" for k in range(len(shape))], dict(zip(axes, shape, strict=True))
    k = _modes(shape)
    found = {tuple(r[a] for a in axes): complex(r.re, r.im) for r in N.nu2u_spread(points, coords, held, epsilon).collect()}
    exact = np.exp(-1j * (k @ x.T)) @ (re + 1j * im)
    mine = np.array([found[tuple(v + n // 2 for v, n in zip(row, shape, strict=True))] for row in k.tolist()])
    assert np.linalg.norm(mine - exact) <= epsilon * np.linalg.norm(exact)
    values = rng.normal(size=len(k)) + 1j * rng.normal(size=len(k))
    rows = [(*[int(v + n // 2) for v, n in zip(row, shape, strict=True)], float(v.real), float(v.imag)) for row, v in zip(k.tolist(), values, strict=True)]
    modes = spark.createDataFrame(rows, ", ".join(f"{a} long" for a in axes) + ", re double, im double")
    back = {r.pid: complex(r.re, r.im) for r in N.u2nu_spread(modes, held, points, coords, "pid", epsilon, False).collect()}
    exact = np.exp(1j * (x @ k.T)) @ values
    assert len(back) == len(x)
    assert np.linalg.norm(np.array([back[i] for i in range(len(x))]) - exact) <= epsilon * np.linalg.norm(exact)


@pytest.mark.parametrize("sigma", [(1.2, 1.3), (1.75, 2.0), (2.4, 2.5)])
def test_plan_serves_many_sets_of_values(spark, sigma):
    rng, shape = np.random.default_rng(7), {"a": 10, "b": 8}
    x, re, im = _points(rng, 80, 2)
    points = _frame(spark, x, re, im)
    plan = N.Plan(points, ["x0", "x1"], shape, "pid", 1e-7, [1.0, 2.5], True, *sigma)
    assert sigma[0] <= plan.kernel.sigma <= sigma[1]
    for scale in (1.0, -2.0):
        values = points.selectExpr("pid", f"re * {scale} as re", "im")
        got = {(r.a, r.b): (r.re, r.im) for r in plan.nu2u(values).collect()}
        want = {(r.a, r.b): (r.re, r.im) for r in N.nu2u(values.join(points.drop("re", "im"), "pid"), ["x0", "x1"], shape, True, [1.0, 2.5], True).collect()}
        size = max(abs(v) for w in want.values() for v in w)
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 * size for k in want for a, b in zip(got[k], want[k], strict=True))
    modes = spark.createDataFrame([(a, b, float(a - b), float(a * b)) for a in range(10) for b in range(8)], "a long, b long, re double, im double")
    got = {r.pid: (r.re, r.im) for r in plan.u2nu(modes).collect()}
    want = {r.pid: (r.re, r.im) for r in N.u2nu(modes, shape, points, ["x0", "x1"], "pid", True, [1.0, 2.5], True).collect()}
    size = max(abs(v) for w in want.values() for v in w)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-6 * size for k in want for a, b in zip(got[k], want[k], strict=True))
    plan.close()


def test_no_points_and_no_modes(spark):
    empty = spark.createDataFrame([], "pid long, x0 double, re double, im double")
    modes = spark.createDataFrame([], "k0 long, re double, im double")
    assert N.nu2u_spread(empty, ["x0"], {"k0": 5}).collect() == []
    some = spark.createDataFrame([(1, 0.5, 1.0, 0.0)], "pid long, x0 double, re double, im double")
    assert [tuple(r) for r in N.u2nu_spread(modes, {"k0": 5}, some, ["x0"]).collect()] == [(1, 0.0, 0.0)]
    assert N.u2nu_spread(modes, {"k0": 5}, empty, ["x0"]).collect() == []


def test_real_sums_in_three_dimensions(spark):
    rng, shape = np.random.default_rng(9), {"a": 5, "b": 6, "c": 4}
    x, re, _ = _points(rng, 60, 3)
    points = _frame(spark, x, re, re).select("pid", "x0", "x1", "x2", "re").withColumnRenamed("re", "value")
    coords, k = ["x0", "x1", "x2"], _modes(tuple(shape.values()))
    given = rng.normal(size=len(k))
    rows = [(*[int(v + n // 2) for v, n in zip(row, shape.values(), strict=True)], float(v)) for row, v in zip(k.tolist(), given, strict=True)]
    modes = spark.createDataFrame(rows, "a long, b long, c long, value double")
    there = {r.pid: r.value for r in N.u2nu_real(modes, shape, points, coords, "pid", 1e-9).collect()}
    exact = (np.exp(-1j * (x @ k.T)) @ given).real
    assert np.linalg.norm(np.array([there[i] for i in range(60)]) - exact) <= 1e-9 * np.linalg.norm(np.exp(-1j * (x @ k.T)) @ given)
    back = {(r.a, r.b, r.c): r.value for r in N.nu2u_real(points, coords, shape, 1e-9).collect()}
    assert sum(there[i] * re[i] for i in range(60)) == pytest.approx(sum(back[r[:3]] * r[3] for r in rows), rel=1e-8)
