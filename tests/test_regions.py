"""Discs, polygons and strips of pixels in both schemes, and range sets, against plain sets."""

import math

import numpy as np
import pytest

from tessera.functions import healpix as X
from tessera.operators import ranges as R
from tessera.operators import sphere as P


def _centers(nside, scheme):
    return np.stack(X.pix2vec(nside, np.arange(X.npix(nside)), scheme), axis=1)


def _set(df):
    return {v for r in df.collect() for v in range(r.lo, r.hi)}


@pytest.mark.parametrize("nside", [1, 2, 16, 64])
@pytest.mark.parametrize("scheme", ["RING", "NEST"])
def test_discs_equal_all_centers(spark, nside, scheme):
    rng = np.random.default_rng(nside)
    discs = [(i, float(math.acos(rng.uniform(-1, 1))), float(rng.uniform(0, 6)), float(r)) for i, r in enumerate((0.01, 0.3, 1.0, 2.5, 3.2))] + [(9, 0.0, 0.0, 0.4), (10, math.pi, 0.0, 0.4)]
    found = P.query_disc(spark.createDataFrame(discs, "id long, theta double, phi double, radius double"), nside, scheme)
    rows = found.collect()
    v = _centers(nside, scheme)
    for i, theta, phi, radius in discs:
        c = np.array(X.ang2vec(theta, phi))
        inside = np.arctan2(np.linalg.norm(np.cross(v, c), axis=1), v @ c) <= radius
        assert {x for r in rows if r.id == i for x in range(r.lo, r.hi)} == set(np.flatnonzero(inside).tolist()), (i, radius)


@pytest.mark.parametrize("scheme", ["RING", "NEST"])
def test_polygons_equal_all_centers(spark, scheme):
    nside, rng = 32, np.random.default_rng(2)
    v = _centers(nside, scheme)
    for k in (3, 4, 6):
        middle = rng.normal(size=3)
        middle /= np.linalg.norm(middle)
        a = np.cross(middle, [0.3, 0.5, 0.8])
        a /= np.linalg.norm(a)
        b, size = np.cross(middle, a), rng.uniform(0.1, 0.8)
        corners = [middle + size * (math.cos(t) * a + math.sin(t) * b) for t in 2 * math.pi * (np.arange(k) + 0.1) / k]
        angles = [tuple(float(x) for x in X.vec2ang(*(c / np.linalg.norm(c)))) for c in corners]
        sides = [np.cross(p, q) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]
        inside = set(np.flatnonzero(np.all([v @ s >= 0 for s in sides], axis=0)).tolist())
        assert _set(P.query_polygon(spark, nside, angles, False, scheme)) == inside
        more = _set(P.query_polygon(spark, nside, angles, True, scheme))
        assert inside < more and len(more) < len(inside) + 60 * k * nside * size / 3
    with pytest.raises(ValueError):
        P.query_polygon(spark, nside, [(0.5, 0.1), (0.9, 0.3), (0.6, 0.2), (0.5, 1.0)])


def test_a_fine_map_is_not_looked_through(spark):
    """At 2**20 the whole sphere has 13 billion pixels; a small disc's ranges come from the cells at its border."""
    nside = 1 << 20
    disc = spark.createDataFrame([(1, 1.1, 2.0, 2e-4)], "id long, theta double, phi double, radius double")
    nest, ring = (P.query_disc(disc, nside, s).collect() for s in ("NEST", "RING"))
    assert sum(r.hi - r.lo for r in nest) == sum(r.hi - r.lo for r in ring) > 50_000
    corner = int(X.ang2pix(nside, np.array([1.1]), np.array([2.0]), "NEST")[0])
    assert any(r.lo <= corner < r.hi for r in nest) and len(nest) < 20_000


@pytest.mark.parametrize("low,high", [(0.4, 1.1), (2.0, 1.0)])
def test_strips(spark, low, high):
    nside = 8
    theta, _ = X.pix2ang(nside, np.arange(X.npix(nside)))
    inside = (theta >= low) & (theta <= high) if low < high else (theta <= high) | (theta >= low)
    assert _set(P.query_strip(spark, nside, low, high)) == set(np.flatnonzero(inside).tolist())
    assert _set(P.query_strip(spark, nside, low, high)) < _set(P.query_strip(spark, nside, low, high, True))


def test_disc_inclusive_holds_every_pixel_that_overlaps(spark):
    nside, disc = 8, spark.createDataFrame([(1, 1.0, 0.5, 0.21)], "id long, theta double, phi double, radius double")
    fine = _set(P.query_disc(disc, 64, "NEST"))
    assert {p >> 6 for p in fine} <= _set(P.query_disc_inclusive(disc, nside, "NEST"))
    assert _set(P.query_disc(disc, nside)) < _set(P.query_disc_inclusive(disc, nside))


def test_range_sets(spark):
    rng = np.random.default_rng(3)
    rows = [[(int(k), int(a), int(a + n)) for k, a, n in zip(rng.integers(0, 3, 40), rng.integers(0, 200, 40), rng.integers(0, 12, 40), strict=True)] for _ in range(2)]
    a, b = (spark.createDataFrame(r, "k long, lo long, hi long") for r in rows)
    held = [{(k, v) for k, lo, hi in r for v in range(lo, hi)} for r in rows]
    plain = lambda df: {(r.k, v) for r in df.collect() for v in range(r.lo, r.hi)}
    assert plain(R.complement(a, -5, 230, ["k"])) == {(k, v) for k in {x[0] for x in held[0]} for v in range(-5, 230)} - held[0]
    assert {r.k for r in R.overlaps(a, b, ["k"]).collect()} == {k for k, _ in held[0] & held[1]}
    points = spark.createDataFrame([(k, v) for k in range(4) for v in range(-3, 215, 4)], "k long, v long")
    assert {(r.k, r.v) for r in R.contains(a, points, "v", ["k"]).collect() if r.inside} == held[0] & {(k, v) for k in range(4) for v in range(-3, 215, 4)}
    values = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (2, 9), (2, None)], "k long, v long")
    assert {tuple(r) for r in R.from_values(values, "v", ["k"]).collect()} == {(1, 5, 7), (2, 9, 10)}


def test_statistics_and_medians(spark):
    nside, rng = 8, np.random.default_rng(4)
    values = rng.normal(size=X.npix(nside))
    pixels = spark.createDataFrame([(i, None if i % 7 == 0 else float(v)) for i, v in enumerate(values)], "pix long, value double")
    known = np.array([v for i, v in enumerate(values) if i % 7])
    row = P.statistics(pixels).first().asDict()
    assert row["n"] == len(known) if "n" in row else True
    assert any(x == pytest.approx(known.mean()) for x in row.values() if isinstance(x, float))
    assert any(x == pytest.approx(np.abs(known).max()) for x in row.values() if isinstance(x, float))


def _cells(lo, hi, order):
    """The fewest whole cells of a range by the definition, and the integers beyond the last pixel one by one."""
    out, end = [], 12 << 2 * order
    while lo < hi:
        depth = next(d for d in range(order + 1) if d == order or (lo < end and lo % 4 ** (order - d) == 0 and lo + 4 ** (order - d) <= min(hi, end)))
        out.append(4 ** (depth + 1) + lo // 4 ** (order - depth))
        lo += 4 ** (order - depth)
    return out


@pytest.mark.parametrize("order", [0, 1, 3, 6, 29])
def test_cells_and_integers_beyond_the_last_pixel(spark, order):
    """Keys above 12 * 4**order once took numbers of deeper cells, and came back wrong or overflowed."""
    rng, end = np.random.default_rng(order), 12 << 2 * order
    most = min(end, 5000)
    rows = [(1, max(0, end - 21), end + 30), (2, end, end + 3), (3, 16 * end // 12, 16 * end // 12 + 2), (4, 0, end if order < 4 else 4**4)] if order < 29 else [(1, end - 21, end), (4, 0, 4**29)]
    rows += [(5, int(a), int(a + n)) for a, n in zip(rng.integers(0, most, 30), rng.integers(0, 90, 30), strict=True)]
    sets = spark.createDataFrame(rows, "k long, lo long, hi long")
    plain = sorted(tuple(r) for r in R.normalise(sets, ["k"]).collect())
    cells = R.to_uniq(sets, order, ["k"])
    assert sorted(tuple(r) for r in cells.collect()) == sorted((k, u) for k, lo, hi in plain for u in _cells(lo, hi, order))
    assert sorted(tuple(r) for r in R.from_uniq(cells, order, ["k"]).collect()) == plain


def test_negative_integers_have_no_cell(spark):
    with pytest.raises(Exception, match="numbered from 0"):
        R.to_uniq(spark.createDataFrame([(-3, 4)], "lo long, hi long"), 2).collect()
