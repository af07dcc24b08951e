"""Transforms of long axes, in two steps or by a chirp, against the plain weighted sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import spectral as S


def table(spark, n, two=False, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(b, i, float(rng.normal()), float(rng.normal())) for b in range(2) for i in range(n) if i % 5 != 3]
    df = spark.createDataFrame(rows, "b long, n long, re double, im double")
    return df if two else df.select("b", "n", F.col("re").alias("value"))


def cells(df, names):
    return {(r.b, r.n): np.array([r[c] for c in names]) for r in df.collect()}


def same(found, expect, names):
    a, b = cells(found, names), cells(expect, names)
    for key in a.keys() | b.keys():
        assert np.allclose(a.get(key, 0.0), b.get(key, 0.0), atol=1e-9), key


REAL = {
    "r2c": (lambda x, n: S.r2c(x, {"n": n}, ["n"], inorm=1), ("re", "im")),
    "r2c_back": (lambda x, n: S.r2c(x, {"n": n}, ["n"], False), ("re", "im")),
    "fftpack": (lambda x, n: S.r2r_fftpack(x, {"n": n}, ["n"]), ("value",)),
    "fftw_back": (lambda x, n: S.r2r_fftw(x, {"n": n}, ["n"], False, False), ("value",)),
    "hartley": (lambda x, n: S.separable_hartley(x, {"n": n}, ["n"]), ("value",)),
    "fht": (lambda x, n: S.genuine_fht(x, {"n": n}, ["n"]), ("value",)),
} | {f"{f.__name__}{k}_{o}": (lambda x, n, f=f, k=k, o=o: f(x, {"n": n}, k, ["n"], o), ("value",)) for f in (S.dct, S.dst) for k in (1, 2, 3, 4) for o in (0, 1)}


@pytest.mark.parametrize("name", REAL)
def test_long_real_transforms_equal_the_sums(spark, monkeypatch, name):
    run, names = REAL[name]
    for n in (11, 12):
        x = table(spark, n)
        expect = run(x, n)
        with monkeypatch.context() as patch:
            patch.setattr(S, "EXACT_LENGTH", 4)
            found = run(x, n)
        same(found, expect, names)


@pytest.mark.parametrize("n", [7, 12, 37])
@pytest.mark.parametrize("forward", [True, False])
def test_chirp_equals_the_sum(spark, n, forward):
    x = table(spark, n, two=True)
    same(S.chirped(x, "n", n, forward), S.c2c(x, {"n": n}, ["n"], forward), ("re", "im"))


@pytest.mark.parametrize("n,lastsize", [(7, 12), (7, 13)])
def test_long_half_complex_to_real(spark, monkeypatch, n, lastsize):
    x = table(spark, n, two=True)
    expect = S.c2r(x, {"n": n}, ["n"], lastsize)
    monkeypatch.setattr(S, "EXACT_LENGTH", 4)
    same(S.c2r(x, {"n": n}, ["n"], lastsize), expect, ("value",))


@pytest.mark.parametrize("n,n_out", [(12, 12), (12, 8), (12, 16), (11, 8), (11, 15), (12, 7)])
def test_long_convolution(spark, monkeypatch, n, n_out):
    x = table(spark, n)
    kernel = spark.createDataFrame([(0, 1.0), (1, 0.5), (n - 1, 0.25)], "n long, value double")
    expect = S.convolve_axis(x, {"n": n}, "n", kernel, n_out)
    monkeypatch.setattr(S, "EXACT_LENGTH", 4)
    same(S.convolve_axis(x, {"n": n}, "n", kernel, n_out), expect, ("value",))


@pytest.mark.parametrize("real", [False, True])
def test_good_sizes_are_found_by_halving(spark, real):
    """Each length was once held against every smooth number."""
    limit = 64
    lengths = spark.range(-1, 2 * limit + 3).select(F.when(F.col("id") >= 0, F.col("id")).alias("n"))
    found = S.good_sizes(lengths, "n", limit, real)
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        assert r.good_size == (None if r.n is None or r.n > 2 * limit else S.good_size(r.n, real))
