"""Spread gridding against the exact sums, and its two directions against each other."""

import math

import numpy as np
import pytest

from tessera.operators import gridding as G
from tessera.operators import spreading

NPIX, SIZE = (16, 12), (0.012, 0.015)


def _vis(spark, seed=1, rows=60, chans=2, wide=400.0):
    rng = np.random.default_rng(seed)
    base = spark.createDataFrame([(i, *map(float, rng.uniform(-wide, wide, 3))) for i in range(rows)], "row long, u double, v double, w double")
    freq = spark.createDataFrame([(c, 1e8 * (1 + 0.3 * c)) for c in range(chans)], "chan long, freq double")
    vis = [(i, c, float(rng.normal()), float(rng.normal()), float(rng.uniform(0, 2)), bool(rng.random() < 0.8)) for i in range(rows) for c in range(chans)]
    return base, freq, spark.createDataFrame(vis, "row long, chan long, re double, im double, wgt double, mask boolean").repartition(3)


def _error(a, b):
    a, b = ({k: np.array(v) for k, v in x.items()} for x in (a, b))
    assert a.keys() == b.keys()
    return math.sqrt(sum((abs(a[k] - b[k]) ** 2).sum() for k in b) / sum((abs(b[k]) ** 2).sum() for k in b))


def _image(df):
    return {(r.ix, r.iy): r.value for r in df.collect()}


def _found(df):
    return {(r.row, r.chan): (r.re, r.im) for r in df.collect()}


@pytest.mark.parametrize("epsilon", [1e-3, 1e-6, 1e-9])
@pytest.mark.parametrize("options", [{}, {"wgridding": False}, {"center": (0.1, -0.05), "divide_by_n": False, "flip_v": True}])
def test_spread_forms_equal_exact_sums(spark, monkeypatch, epsilon, options):
    monkeypatch.setattr(spreading, "SIDES", {1: 64, 2: 20, 3: 16})
    monkeypatch.setattr(spreading, "MOST_POINTS", 20)
    base, freq, vis = _vis(spark)
    exact = _image(G.vis2dirty(base, freq, vis, NPIX, SIZE, **options))
    assert _error(_image(G.vis2dirty_spread(base, freq, vis, NPIX, SIZE, epsilon, **options)), exact) < epsilon
    rng = np.random.default_rng(2)
    image = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(NPIX[0]) for j in range(NPIX[1])], "ix long, iy long, value double")
    exact = _found(G.dirty2vis(base, freq, image, NPIX, SIZE, vis, **options))
    assert _error(_found(G.dirty2vis_spread(base, freq, image, NPIX, SIZE, vis, epsilon, **options)), exact) < epsilon


@pytest.mark.parametrize("sigma", [(1.2, 1.5), (2.0, 2.5)])
def test_directions_are_adjoint(spark, sigma):
    base, freq, vis = _vis(spark, 3)
    rng = np.random.default_rng(4)
    pixels = {(i, j): float(rng.normal()) for i in range(NPIX[0]) for j in range(NPIX[1])}
    image = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "ix long, iy long, value double")
    dirty = _image(G.vis2dirty_spread(base, freq, vis, NPIX, SIZE, 1e-3, sigma_min=sigma[0], sigma_max=sigma[1]))
    seen = _found(G.dirty2vis_spread(base, freq, image, NPIX, SIZE, vis, 1e-3, sigma_min=sigma[0], sigma_max=sigma[1]))
    held = {(r.row, r.chan): (r.re, r.im) for r in vis.collect()}
    left = sum(dirty[k] * v for k, v in pixels.items())
    right = sum(seen[k][0] * held[k][0] + seen[k][1] * held[k][1] for k in held)
    assert left == pytest.approx(right, rel=1e-11)


def test_no_visibilities_and_images_that_do_not_fit(spark):
    base, freq, vis = _vis(spark)
    assert set(_image(G.vis2dirty_spread(base, freq, vis.where("false"), NPIX, SIZE)).values()) == {0.0}
    with pytest.raises(ValueError):
        G.vis2dirty_spread(base, freq, vis, (15, 12), SIZE)
    with pytest.raises(ValueError):
        G.vis2dirty_spread(base, freq, vis, (200, 200), (0.012, 0.012))


def test_channels_histogram_and_compaction(spark):
    base, freq, vis = _vis(spark)
    assert G.checked_channels(freq).count() == 2
    with pytest.raises(ValueError):
        G.checked_channels(spark.createDataFrame([(0, 2e8), (1, 1e8)], "chan long, freq double"))
    assert sum(r.n for r in G.w_histogram(base, freq, vis, 7).collect()) == vis.where("mask and wgt <> 0").count()
    both = spark.createDataFrame([(0, 0, "xx", 1.0, 2.0, 1.0, False), (0, 0, "yy", 3.0, 0.0, 3.0, False), (1, 0, "xx", 5.0, 5.0, 1.0, True)], "row long, chan long, corr string, re double, im double, wgt double, flag boolean")
    assert [tuple(r) for r in G.compact(both).collect()] == [(0, 0, 2.5, 0.5, 4.0)]


def test_older_names(spark):
    base, freq, vis = _vis(spark, rows=12)
    exact = _image(G.vis2dirty(base, freq, vis, NPIX, SIZE, wgridding=False))
    assert _error(_image(G.ms2dirty(base, freq, vis, NPIX, SIZE, 1e-5)), exact) < 1e-5
    image = spark.createDataFrame([(i, j, float(i - j)) for i in range(NPIX[0]) for j in range(NPIX[1])], "ix long, iy long, value double")
    exact = _found(G.dirty2vis(base, freq, image, NPIX, SIZE, vis))
    assert _error(_found(G.dirty2ms(base, freq, image, NPIX, SIZE, 1e-5, True, vis)), exact) < 1e-5
