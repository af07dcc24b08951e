"""Scalars and small operators that no registered query calls, against plain versions."""

import math

import numpy as np
import pytest

from tessera.functions import healpix as X
from tessera.operators import harmonic as H
from tessera.operators import numeric as M
from tessera.operators import pointing as Q
from tessera.operators import sphere as P

SCHEMA = "comp long, l long, m long, re double, im double"


def _times(a, b):
    """Hamilton's product of (x, y, z, w) by the rule for scalars and vectors."""
    va, vb, sa, sb = np.array(a[:3]), np.array(b[:3]), a[3], b[3]
    return np.r_[sa * vb + sb * va + np.cross(va, vb), sa * sb - va @ vb]


@pytest.mark.parametrize("left", [True, False])
def test_pointing_turned_by_a_constant(spark, left):
    """Between two samples the turn from one to the other goes at constant speed; a turn of twice a unit is made a unit."""
    rng = np.random.default_rng(1)
    given = rng.normal(size=(5, 4))
    turn = (0.4, -1.0, 0.8, 1.6)
    quats = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(given)], "i long, x double, y double, z double, w double")
    found = {r.i: np.array(r[1:]) for r in Q.rotated_quaternions(spark, quats, 5, 10.0, 2.0, 9.3, 7.0, turn, left, 40).collect()}
    unit, fixed = given / np.linalg.norm(given, axis=1)[:, None], np.array(turn) / np.linalg.norm(turn)
    for i in range(40):
        place = ((9.3 + i / 7.0 - 10.0) * 2.0) % 5
        k, f = int(place), place - int(place)
        a, b = unit[k], unit[(k + 1) % 5]
        between = _times(b * np.sign(a @ b), a * [-1, -1, -1, 1])  # from a to b by the shorter way
        half = math.atan2(np.linalg.norm(between[:3]), between[3])
        part = np.r_[between[:3] / np.linalg.norm(between[:3]) * math.sin(f * half), math.cos(f * half)]
        mid = _times(part, a)
        expect = _times(fixed, mid) if left else _times(mid, fixed)
        assert min(np.abs(found[i] - expect).max(), np.abs(found[i] + expect).max()) < 1e-13


def test_last_position(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 3, 0.3), ("a", 2, 0.2), ("b", 9, 0.9)], "k string, t long, x double")
    assert {tuple(r) for r in Q.last_position(df, "k", "t").collect()} == {("a", 3, 0.3), ("b", 9, 0.9)}


@pytest.mark.parametrize("nside", [1, 2, 3, 8, 12, 64])
def test_scalars_of_a_pixelisation(nside):
    assert X.npix(nside) == 12 * nside**2 and X.pix_area(nside) * X.npix(nside) == pytest.approx(4 * math.pi)
    assert X.order(nside) == (int(math.log2(nside)) if nside in (1, 2, 8, 64) else -1)
    pix = np.arange(X.npix(nside))
    z, phi = X.boundaries(nside, pix, 4)
    s = np.sqrt(1 - np.clip(z, -1, 1) ** 2)
    corners = np.stack([s * np.cos(phi), s * np.sin(phi), z], axis=2)
    centers = np.stack(X.pix2vec(nside, pix), axis=1)[:, None]
    far = np.arctan2(np.linalg.norm(np.cross(corners, centers), axis=2), (corners * centers).sum(axis=2)).max()
    assert far == pytest.approx(X.max_pixrad(nside), rel=1e-9)
    with pytest.raises(ValueError):
        X.checked(3, "NEST")


def test_rings_of_pixels(spark):
    nside = 8
    pixels = spark.range(X.npix(nside)).withColumnRenamed("id", "pix")
    theta = {r.ring: r.theta for r in P.rings(spark, nside).collect()}
    for scheme in ("RING", "NEST"):
        rows = P.pix2ang(P.pix2ring(pixels, nside, scheme), nside, scheme).collect()
        assert all(abs(r.theta - theta[r.ring]) < 1e-12 for r in rows)
    z = np.array([0.9999, 0.5, 0.0, -0.5, -0.9999])
    above = X.ring_above(nside, z)
    zs = X.ring_z(nside, np.arange(0, 4 * nside + 1))
    assert all(zs[a] >= v - 1e-12 and zs[a + 1] < v for a, v in zip(above, z, strict=True))


def test_median_within(spark):
    nside, rng = 16, np.random.default_rng(2)
    values = rng.normal(size=X.npix(nside))
    pixels = spark.createDataFrame([(i, None if i % 5 == 0 else float(v)) for i, v in enumerate(values)], "pix long, value double")
    points = spark.createDataFrame([(1, 0.7, 1.0, 0.3), (2, 2.9, 5.0, 0.5)], "id long, theta double, phi double, radius double")
    v = np.stack(X.pix2vec(nside, np.arange(X.npix(nside))), axis=1)
    for r in P.median_within(points, pixels, nside).collect():
        theta, phi, radius = {1: (0.7, 1.0, 0.3), 2: (2.9, 5.0, 0.5)}[r.id]
        inside = [i for i in np.flatnonzero(v @ np.array(X.ang2vec(theta, phi)) >= math.cos(radius)) if i % 5]
        assert r.n == len(inside) and r.value == pytest.approx(np.median(values[inside]))


@pytest.mark.parametrize("geometry", ["CC", "F1", "F2", "DH", "GL", "MW", "MWflip"])
def test_grids_carry_the_degrees_they_claim(spark, geometry):
    """Coefficients up to the highest safe degree come back from the grid; weights add up to the sphere."""
    n = 10
    safe = H.maximum_safe_l(geometry, n)
    rows = [(0, k, m, float(k - m + 1), float(m)) for k in range(safe + 1) for m in range(min(k, 2) + 1)]
    alm = spark.createDataFrame(rows, SCHEMA)
    back = {(r.l, r.m): (r.re, r.im) for r in H.analysis_2d(H.synthesis_2d(alm, geometry, n, 5, safe, 2), geometry, n, 5, safe, 2).collect()}
    assert all(abs(back[r[1:3]][0] - r[3]) + abs(back[r[1:3]][1] - r[4]) < 1e-11 for r in rows)
    if geometry in ("MW", "MWflip"):
        with pytest.raises(ValueError):
            H.grid_weights(geometry, n)
    else:
        assert H.grid_weights(geometry, n).sum() == pytest.approx(4 * math.pi)


def test_derivatives_on_a_grid(spark):
    alm = spark.createDataFrame([(0, 3, 1, 0.4, -0.7), (0, 2, 0, 1.1, 0.0)], SCHEMA)
    one = {tuple(r)[:3]: r.value for r in H.synthesis_2d_deriv1(alm, "F1", 5, 7, 3, 1, 0.2).collect()}
    other = {tuple(r)[:3]: r.value for r in H.synthesis_deriv1(alm, H.rings_2d(spark, "F1", 5, 7, 0.2), 3, 1).collect()}
    assert one == pytest.approx(other) and len(one) == 70


def test_weights_indices_and_numbers(spark):
    assert sum(r.weight for r in M.gl_weights(spark, 6, 10).collect()) * 10 == pytest.approx(4 * math.pi)
    df = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, value double")
    assert M.transpose(df, {"b": "a", "a": "b"}).first().asDict() == {"b": 1, "a": 2, "value": 0.5}
    cells = spark.createDataFrame([(5, 3, 6), (1023, 0, 511)], "x long, y long, z long").withColumn("m", M.morton(["x", "y", "z"], 10))
    for r in cells.select("*", *[M.unmorton("m", 3, k, 10).alias(f"b{k}") for k in range(3)]).collect():
        assert (r.b0, r.b1, r.b2) == (r.x, r.y, r.z)
        assert r.m == sum((v >> b & 1) << 3 * b + d for d, v in enumerate((r.x, r.y, r.z)) for b in range(10))
