"""Rotation, beams, derivatives and least squares against plain sums."""

import math

import numpy as np
import pytest

from tessera.operators import harmonic as H
from tessera.operators import rotation as R

SCHEMA = "comp long, l long, m long, re double, im double"


def _alm(rng, lmax, mmax=None, comps=1, least=0):
    return [(c, k, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for c in range(comps) for k in range(least, lmax + 1) for m in range(min(k, lmax if mmax is None else mmax) + 1)]


def _small_d(l, a, b, theta):  # noqa: E741
    f, total = math.factorial, 0.0
    for s in range(max(0, b - a), min(l + b, l - a) + 1):
        part = (-1) ** (a - b + s) / (f(l + b - s) * f(s) * f(a - b + s) * f(l - a - s))
        total += part * math.cos(theta / 2) ** (2 * l + b - a - 2 * s) * math.sin(theta / 2) ** (a - b + 2 * s)
    return total * math.sqrt(f(l + a) * f(l - a) * f(l + b) * f(l - b))


def _full(rows):
    out = {}
    for c, k, m, re, im in rows:
        out[c, k, m] = complex(re, im)
        out[c, k, -m] = (-1) ** m * complex(re, -im)
    return out


def _turned(rows, psi, theta, phi):
    """All coefficients of the turned function by the published sum."""
    given = _full(rows)
    return {(c, k, m): sum(np.exp(-1j * (m * phi + n * psi)) * _small_d(k, m, n, theta) * given.get((c, k, n), 0) for n in range(-k, k + 1)) for c, k in {r[:2] for r in rows} for m in range(-k, k + 1)}


def test_rotation_equals_the_sum(spark):
    rows = _alm(np.random.default_rng(1), 7, comps=2)
    expected = _turned(rows, 0.4, 2.1, -1.3)
    found = R.rotate_alm(spark.createDataFrame(rows, SCHEMA), 0.4, 2.1, -1.3).collect()
    assert len(found) == len(rows)
    assert all(abs(complex(r.re, r.im) - expected[r.comp, r.l, r.m]) < 1e-12 for r in found)


@pytest.mark.parametrize("theta", [1e-9, 0.7, math.pi, -2.0, 9.0])
def test_turns_of_high_degree_keep_length_and_undo(theta):
    v = np.random.default_rng(2).normal(size=2001) + 0j
    there = R.tilted(v, 1000, theta)
    assert np.linalg.norm(there) == pytest.approx(np.linalg.norm(v), rel=1e-11)
    assert np.allclose(R.tilted(there, 1000, -theta), v, atol=1e-10)


def test_sky_seen_by_a_turned_beam(spark):
    lmax, kmax, rng = 5, 3, np.random.default_rng(3)
    sky, beam = _alm(rng, lmax, comps=2), _alm(rng, lmax, kmax, comps=2)
    points = [(i, float(rng.uniform(0.1, 3)), float(rng.uniform(0, 6)), float(rng.uniform(0, 6)), float(rng.normal())) for i in range(6)]
    s, b = spark.createDataFrame(sky, SCHEMA), spark.createDataFrame(beam, SCHEMA)
    p = spark.createDataFrame(points, "id long, theta double, phi double, psi double, value double")
    found = {r.id: r.value for r in R.convolved(s, b, p, lmax, kmax).collect()}
    full = _full(sky)
    for i, theta, phi, psi, _ in points:
        turned = _turned(beam, psi, theta, phi)
        assert found[i] == pytest.approx(sum((v * np.conj(turned[k])).real for k, v in full.items()), abs=1e-10)
    back = {(r.comp, r.l, r.m): r for r in R.convolved_adjoint(p, b, lmax, kmax).collect()}
    inside = sum((2 if m else 1) * (re * back[c, k, m].re + im * back[c, k, m].im) for c, k, m, re, im in sky)
    assert inside == pytest.approx(sum(found[i] * v for i, *_, v in points))
    rings = p.selectExpr("id as ring", "theta", "1L as nphi", "phi as phi0")
    planes = {(r.ring, r.k, r.comp): r.value for r in R.beam_planes(s, b, rings, lmax, kmax).collect()}
    for i, _, _, psi, _ in points:
        total = planes[i, 0, 0] + sum(2 * (planes[i, k, 0] * math.cos(k * psi) + planes[i, k, 1] * math.sin(k * psi)) for k in range(1, kmax + 1))
        assert total == pytest.approx(found[i])


def test_derivatives_equal_differences(spark):
    lmax, step = 6, 1e-5
    alm = spark.createDataFrame(_alm(np.random.default_rng(4), lmax), SCHEMA)
    places = [(0, 0.5, 0.3), (1, 1.4, 2.0), (2, 2.7, 5.0)]
    near = [(10 * i + j, t + a * step, p + b * step) for i, t, p in places for j, (a, b) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1)))]
    v = {r.id: r.value for r in H.synthesis_general(alm, spark.createDataFrame(near, "id long, theta double, phi double"), lmax, lmax).collect()}
    rings = spark.createDataFrame([(i, t, 1, p) for i, t, p in places], "ring long, theta double, nphi long, phi0 double")
    found = {(r.ring, r.comp): r.value for r in H.synthesis_deriv1(alm, rings, lmax, lmax).collect()}
    for i, t, _ in places:
        assert found[i, 0] == pytest.approx((v[10 * i] - v[10 * i + 1]) / (2 * step), abs=1e-6)
        assert found[i, 1] == pytest.approx((v[10 * i + 2] - v[10 * i + 3]) / (2 * step * math.sin(t)), abs=1e-6)


@pytest.mark.parametrize("geometry,n,spin", [("CC", 6, 0), ("CC", 7, 1), ("F1", 5, 2), ("MW", 5, 0), ("MW", 8, 1), ("MWflip", 5, 2)])
def test_analysis_from_few_rings(spark, geometry, n, spin):
    lmax, nphi, rng = 4, 9, np.random.default_rng(spin)
    rows = _alm(rng, lmax, comps=2 if spin else 1, least=spin)
    alm = spark.createDataFrame(rows, SCHEMA)
    found = {(r.comp, r.l, r.m): r for r in H.analysis_2d(H.synthesis_2d(alm, geometry, n, nphi, lmax, lmax, spin), geometry, n, nphi, lmax, lmax, spin).collect()}
    assert all(abs(found[r[:3]].re - r[3]) + abs(found[r[:3]].im - r[4]) < 1e-12 for r in rows)
    values = [(c, r, i, float(rng.normal())) for c in range(2 if spin else 1) for r in range(n) for i in range(nphi)]
    back = {(r.comp, r.l, r.m): r for r in H.analysis_2d(spark.createDataFrame(values, "comp long, ring long, ipix long, value double"), geometry, n, nphi, lmax, lmax, spin).collect()}
    image = {(r.comp, r.ring, r.ipix): r.value for r in H.adjoint_analysis_2d(alm, geometry, n, nphi, lmax, lmax, spin).collect()}
    inside = sum((2 if m else 1) * (re * back[c, k, m].re + im * back[c, k, m].im) for c, k, m, re, im in rows)
    assert inside == pytest.approx(sum(image[v[:3]] * v[3] for v in values))


def test_least_squares_finds_the_coefficients(spark):
    lmax, rng = 2, np.random.default_rng(5)
    rows = _alm(rng, lmax)
    alm = spark.createDataFrame(rows, SCHEMA)
    rings = H.rings_2d(spark, "F1", 5, 6, 0.1)
    x, steps, left = R.pseudo_analysis(H.synthesis(alm, rings, lmax, lmax), rings, lmax, lmax, maxiter=12, epsilon=1e-9)
    found = {(r.comp, r.l, r.m): r for r in x.collect()}
    assert 0 < steps <= 12 and left < 1e-8
    assert all(abs(found[r[:3]].re - r[3]) + abs(found[r[:3]].im - r[4]) < 1e-7 for r in rows)
    assert R.pseudo_analysis(H.synthesis(alm, rings, lmax, lmax).where("false"), rings, lmax, lmax)[1:] == (0, 0.0)


def test_no_table_of_points_is_broadcast(spark):
    """A broadcast of all points, which Spark chose by the size of a small file, ended the adjoint's driver at 900,000 points."""
    lmax, kmax, rng = 3, 2, np.random.default_rng(6)
    sky, beam = (spark.createDataFrame(_alm(rng, lmax, m), SCHEMA) for m in (lmax, kmax))
    points = spark.range(40).selectExpr("id", "0.1 + id / 20D as theta", "id * 0.3D as phi", "id * 0.2D as psi", "id / 7D - 1 as value")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (H.synthesis_general(sky, points, lmax, lmax), H.adjoint_synthesis_general(points, lmax, lmax)):
        assert "Join" not in plan(df)
    for df, joins in ((R.convolved(sky, beam, points, lmax, kmax), kmax + 1), (R.convolved_adjoint(points, beam, lmax, kmax), kmax + 1)):
        assert plan(df).count("Join") == joins  # each of coefficients only
