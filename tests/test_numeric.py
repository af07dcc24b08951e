"""Exact values of 3j symbols, noise filters and deflections, and adjoint pairs of transforms."""

import math
from itertools import product

import numpy as np
import pytest

from tessera.operators import harmonic as H
from tessera.operators import numeric as M


def racah(l1, l2, l3, m1, m2, m3):
    f = math.factorial
    total = 0.0
    for t in range(60):
        parts = (t, l3 - l2 + t + m1, l3 - l1 + t - m2, l1 + l2 - l3 - t, l1 - t - m1, l2 - t + m2)
        if min(parts) >= 0:
            total += (-1) ** t / math.prod(map(f, parts))
    delta = f(l1 + l2 - l3) * f(l1 - l2 + l3) * f(l2 + l3 - l1) / f(l1 + l2 + l3 + 1)
    rest = f(l1 + m1) * f(l1 - m1) * f(l2 + m2) * f(l2 - m2) * f(l3 + m3) * f(l3 - m3)
    return (-1) ** (l1 - l2 - m3) * math.sqrt(delta * rest) * total


def test_3j_symbols_equal_the_sum():
    for l2, l3 in product(range(7), repeat=2):
        for m2, m3 in product(range(-l2, l2 + 1), range(-l3, l3 + 1)):
            low, values = M.wigner3j(l2, l3, m2, m3)
            exact = [racah(low + k, l2, l3, -m2 - m3, m2, m3) for k in range(len(values))]
            assert np.allclose(values, exact, atol=1e-10), (l2, l3, m2, m3)
    assert M.wigner3j(2, 2, -2, 2)[1][0] == pytest.approx(1 / math.sqrt(5))


def test_noise_stages_fall_with_the_slope():
    stages = M.noise_stages(1e-4, 0.5, 100.0, -1.6)

    def power(f):
        q = np.exp(-2j * math.pi * f / 100.0)
        return np.prod([abs((a + b * q) / (1 - c * q)) ** 2 for a, b, c in stages])

    fall = math.log(power(0.1) / power(0.001)) / math.log(0.1 / 0.001)
    assert fall == pytest.approx(-1.6, abs=0.1)


@pytest.mark.parametrize("spin", [0, 2])
def test_transforms_of_a_grid_and_their_adjoints(spark, spin):
    lmax, n, nphi = 4, 9, 9
    rng = np.random.default_rng(spin)
    rows = [(c, k, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for c in range(2 if spin else 1) for k in range(spin, lmax + 1) for m in range(k + 1)]
    alm = spark.createDataFrame(rows, "comp long, l long, m long, re double, im double")
    pix = spark.createDataFrame([(c, r, i, float(rng.normal())) for c in range(2 if spin else 1) for r in range(n) for i in range(nphi)], "comp long, ring long, ipix long, value double")

    def by(df, *keys):
        return {tuple(r[k] for k in keys): r for r in df.collect()}

    y = by(pix, "comp", "ring", "ipix")
    x = {r[:3]: r for r in rows}

    def inside(found):
        return sum((2 if m else 1) * (r[3] * found[c, k, m].re + r[4] * found[c, k, m].im) for (c, k, m), r in x.items())

    image = by(H.synthesis_2d(alm, "F1", n, nphi, lmax, lmax, spin), "comp", "ring", "ipix")
    back = by(H.adjoint_synthesis_2d(pix, "F1", n, nphi, lmax, lmax, spin), "comp", "l", "m")
    assert sum(image[k].value * y[k].value for k in y) == pytest.approx(inside(back))
    image = by(H.adjoint_analysis_2d(alm, "F1", n, nphi, lmax, lmax, spin), "comp", "ring", "ipix")
    back = by(H.analysis_2d(pix, "F1", n, nphi, lmax, lmax, spin), "comp", "l", "m")
    assert sum(image[k].value * y[k].value for k in y) == pytest.approx(inside(back))
    whole = by(H.from_full(H.to_full(alm, spin), spin), "comp", "l", "m")
    assert all(whole[k].re == pytest.approx(r[3]) and whole[k].im == pytest.approx(r[4]) for k, r in x.items()) and len(whole) == len(x)
