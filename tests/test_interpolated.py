"""Interpolated synthesis and convolution against the exact sums, and recurrences of high degree against long decimals."""

import math
from decimal import Decimal, getcontext

import numpy as np
import pytest

from tessera.operators import harmonic as H
from tessera.operators import interpolated as I
from tessera.operators import rotation as R
from tessera.operators import spreading

SCHEMA = "comp long, l long, m long, re double, im double"


def _alm(rng, lmax, mmax=None, comps=1, least=0):
    return [(c, k, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for c in range(comps) for k in range(least, lmax + 1) for m in range(min(k, lmax if mmax is None else mmax) + 1)]


def _exact_legendre(m, lmax, theta):
    """Normalised values for l = m..lmax in decimals of 60 digits."""
    getcontext().prec = 60
    x = Decimal(math.cos(theta))
    s = (1 - x * x).sqrt()
    value = (Decimal(2 * m + 1) / (4 * Decimal("3.14159265358979323846264338327950288419716939937510582097494459"))).sqrt() * Decimal(math.comb(2 * m, m)).sqrt() / Decimal(2) ** m * s**m * (-1) ** m
    before, out = Decimal(0), []
    for k in range(m, lmax + 1):
        out.append(float(value))
        a = lambda j: (Decimal(j * j - m * m) / Decimal(4 * j * j - 1)).sqrt()
        value, before = (x * value - (a(k) * before if k > m else 0)) / a(k + 1), value
    return np.array(out)


@pytest.mark.parametrize("m,theta", [(0, 0.001), (600, 0.30), (800, 0.41), (1100, 1.2), (2000, 1.4), (2047, 1.57), (1500, 3.0)])
def test_high_degrees_keep_their_digits(m, theta):
    exact = _exact_legendre(m, 2047, theta)
    found = np.array([v[0] for _, v in H.legendre(m, 2047, np.array([theta]))])
    assert np.isfinite(found).all()
    assert np.abs(found - exact).max() <= 3e-10 * max(np.abs(exact).max(), 1e-300)


@pytest.mark.parametrize("m", [0, 1, 3, 700, 1100, 2040])
def test_spin_functions_of_high_degree_are_orthonormal(m):
    """Sums over Gauss-Legendre rings of products of two degrees: 2 for equal ones, 0 for others."""
    x, w = np.polynomial.legendre.leggauss(2100)
    plus, minus = {}, {}
    for k, a, b in H.spin_functions(m, 2, 2047, np.arccos(x)):
        if k in (2, 3, 700, 1100, 2040, 2046, 2047):
            plus[k], minus[k] = a.copy() * math.sqrt(k + 0.5), b.copy() * math.sqrt(k + 0.5)
    for held in (plus, minus):
        for i in held:
            for j in held:
                assert abs((w * held[i] * held[j]).sum() - (i == j)) < 1e-8, (m, i, j)


def test_spin_functions_equal_the_published_sum():
    """Wigner's d for small degrees, by its sum over factorials."""
    f = math.factorial

    def small_d(k, a, b, t):
        return sum((-1) ** (a - b + s) / (f(k + b - s) * f(s) * f(a - b + s) * f(k - a - s)) * math.cos(t / 2) ** (2 * k + b - a - 2 * s) * math.sin(t / 2) ** (a - b + 2 * s) for s in range(max(0, b - a), min(k + b, k - a) + 1)) * math.sqrt(f(k + a) * f(k - a) * f(k + b) * f(k - b))

    theta = np.array([0.0, 0.3, 1.5, 2.9, math.pi])
    for spin in (1, 2, 3):
        for m in range(6):
            for k, plus, minus in H.spin_functions(m, spin, 7, theta):
                for t, p, q in zip(theta, plus, minus, strict=True):
                    assert abs(abs(small_d(k, m, -spin, t)) - abs(q)) < 1e-12 and abs(abs(small_d(k, m, spin, t)) - abs(p)) < 1e-12


@pytest.mark.parametrize("spin", [0, 2])
def test_transform_there_and_back_at_high_order(spark, spin):
    """Coefficients of the highest m only, at a degree where the first values lie far below a double's range."""
    lmax, rng = 1200, np.random.default_rng(1)
    rows = [(c, k, m, float(rng.normal()), float(rng.normal())) for c in range(2 if spin else 1) for m in (900, 1199) for k in range(m, lmax + 1, 97)]
    alm = spark.createDataFrame(rows, SCHEMA)
    rings = H.rings_2d(spark, "GL", lmax + 1, 1)
    leg = H.alm2leg(alm, rings, lmax, lmax, spin).where("m in (900, 1199)")
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(H.grid_weights("GL", lmax + 1))], "ring long, w double")
    back = H.leg2alm(leg.join(weights, "ring").selectExpr("comp", "ring", "m", "re * w as re", "im * w as im"), rings, lmax, spin)
    found = {(r.comp, r.l, r.m): (r.re, r.im) for r in back.collect()}
    given = {r[:3]: r[3:] for r in rows}
    assert all(abs(a - b) < 1e-10 for k, v in found.items() for a, b in zip(v, given.get(k, (0.0, 0.0)), strict=True))
    assert set(given) <= set(found)


@pytest.mark.parametrize("lmax,mmax,spin,epsilon", [(64, 64, 0, 1e-7), (20, 13, 2, 1e-9), (9, 9, 1, 1e-5), (0, 0, 0, 1e-6)])
def test_synthesis_at_points(spark, monkeypatch, lmax, mmax, spin, epsilon):
    monkeypatch.setattr(spreading, "SIDES", {1: 64, 2: 24, 3: 16})
    monkeypatch.setattr(spreading, "MOST_POINTS", 50)
    rng, comps = np.random.default_rng(lmax), 2 if spin else 1
    rows = _alm(rng, lmax, mmax, comps, spin)
    alm = spark.createDataFrame(rows, SCHEMA)
    places = [(0, 0.0, 0.0), (1, math.pi, 1.0), (2, 1e-9, 6.2), *[(i, 0.3, 0.4) for i in range(3, 90)], *[(i, float(rng.uniform(0, math.pi)), float(rng.uniform(-9, 9))) for i in range(90, 200)]]
    points = spark.createDataFrame(places, "id long, theta double, phi double").repartition(3)
    exact = {(r.comp, r.id): r.value for r in H.synthesis_general(alm, points, lmax, mmax, spin).collect()}
    found = {(r.comp, r.id): r.value for r in I.synthesis_general(alm, points, lmax, mmax, spin, epsilon=epsilon).collect()}
    size = math.sqrt(sum(v * v for v in exact.values()))
    assert found.keys() == exact.keys()
    assert math.sqrt(sum((found[k] - exact[k]) ** 2 for k in exact)) <= epsilon * size
    values = [(c, *p, float(rng.normal())) for c in range(comps) for p in places]
    held = spark.createDataFrame(values, "comp long, id long, theta double, phi double, value double")
    exact = {(r.comp, r.l, r.m): complex(r.re, r.im) for r in H.adjoint_synthesis_general(held, lmax, mmax, spin).collect()}
    back = {(r.comp, r.l, r.m): complex(r.re, r.im) for r in I.adjoint_synthesis_general(held, lmax, mmax, spin, epsilon).collect()}
    size = math.sqrt(sum(abs(v) ** 2 for v in exact.values()))
    assert back.keys() == exact.keys()
    assert math.sqrt(sum(abs(back[k] - exact[k]) ** 2 for k in exact)) <= epsilon * size
    left = sum(found[v[:2]] * v[-1] for v in values)
    right = sum((2 if m else 1) * (re * back[c, k, m].real + im * back[c, k, m].imag) for c, k, m, re, im in rows)
    assert left == pytest.approx(right, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("lmax,kmax,comps,epsilon", [(10, 3, 2, 1e-7), (6, 0, 1, 1e-9), (8, 8, 1, 1e-4)])
def test_interpolated_convolution(spark, monkeypatch, lmax, kmax, comps, epsilon):
    monkeypatch.setattr(spreading, "SIDES", {1: 64, 2: 24, 3: 20})
    rng = np.random.default_rng(kmax)
    sky, beam = _alm(rng, lmax, comps=comps), _alm(rng, lmax, kmax, comps=comps)
    places = [(i, float(rng.uniform(0, math.pi)), float(rng.uniform(-3, 9)), float(rng.uniform(-6, 6)), float(rng.normal())) for i in range(60)]
    s, b = spark.createDataFrame(sky, SCHEMA), spark.createDataFrame(beam, SCHEMA)
    p = spark.createDataFrame(places, "id long, theta double, phi double, psi double, value double")
    exact = {r.id: r.value for r in R.convolved(s, b, p, lmax, kmax).collect()}
    plan = I.Convolver(lmax, kmax, epsilon, 100)
    cube = plan.cube(s, b).persist()
    assert cube.agg({"kt": "max", "km": "max", "kp": "max"}).first().asDict() == {"max(kt)": plan.n_theta - 1, "max(km)": plan.n_phi - 1, "max(kp)": plan.n_psi - 1}
    found = {r.id: r.value for r in plan.interpol(cube, p).collect()}
    size = math.sqrt(sum(v * v for v in exact.values()))
    assert math.sqrt(sum((found[k] - exact[k]) ** 2 for k in exact)) <= epsilon * size
    near = p.where("theta between 1.0 and 1.6 and phi between 0.2 and 2.0")
    part = plan.within(cube, plan.patch(1.0, 1.6, 0.2, 2.0))
    assert {r.id: r.value for r in plan.interpol(part, near).collect()} == pytest.approx({r.id: found[r.id] for r in near.collect()}, rel=1e-12, abs=1e-12 * size)
    assert part.count() < cube.count() or plan.n_theta < 3 * plan.kernel.width
    exact = {(r.comp, r.l, r.m): complex(r.re, r.im) for r in R.convolved_adjoint(p, b, lmax, kmax).collect()}
    half, rest = p.where("id < 30"), p.where("id >= 30")
    back = {(r.comp, r.l, r.m): complex(r.re, r.im) for r in plan.coefficients(plan.deinterpol(rest, plan.deinterpol(half)), b).collect()}
    size = math.sqrt(sum(abs(v) ** 2 for v in exact.values()))
    assert back.keys() == exact.keys()
    assert math.sqrt(sum(abs(back[k] - exact[k]) ** 2 for k in exact)) <= epsilon * size
    left = sum(found[i] * v for i, *_, v in places)
    right = sum((2 if m else 1) * (re * back[c, k, m].real + im * back[c, k, m].imag) for c, k, m, re, im in sky)
    assert left == pytest.approx(right, rel=1e-10, abs=1e-9)
    cube.unpersist()
