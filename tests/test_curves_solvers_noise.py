"""Hilbert curves, enclosing circles, bidiagonalisation, and noise filters over tables and streams, against plain versions."""

import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import circles as C
from tessera.operators import curves as V
from tessera.operators import harmonic as H
from tessera.operators import numeric as M
from tessera.operators import solvers as L
from tessera.operators import sphere as P
from tessera.streaming.noise import coloured_noise_stream

SCHEMA = "comp long, l long, m long, re double, im double"


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 4), (3, 1), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"{a} long" for a in "xyz"[:n]))
    rows = cells.withColumn("code", V.hilbert(list("xyz"[:n]), bits)).withColumn("back", V.unhilbert("code", n, bits)).orderBy("code").collect()
    assert [r.code for r in rows] == list(range(1 << n * bits))
    assert all(tuple(r.back) == tuple(r)[:n] for r in rows)
    assert all(sum(abs(a - b) for a, b in zip(tuple(p)[:n], tuple(q)[:n], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n,bits", [(2, 31), (3, 21)])
def test_curve_of_many_bits_and_morton_numbers(spark, n, bits):
    rng = np.random.default_rng(n)
    cells = spark.createDataFrame([tuple(map(int, rng.integers(0, 1 << bits, n))) for _ in range(200)], ", ".join(f"{a} long" for a in "xyz"[:n]))
    morton = sum((F.shiftleft(F.shiftright(F.col(a), b).bitwiseAND(F.lit(1).cast("long")), n * b + d) for d, a in enumerate("xyz"[:n]) for b in range(min(bits, 8))), F.lit(0).cast("long"))
    for r in cells.withColumn("code", V.hilbert(list("xyz"[:n]), bits)).withColumn("back", V.unhilbert("code", n, bits)).collect():
        assert tuple(r.back) == tuple(r)[:n] and 0 <= r.code < 1 << n * bits
    small = cells.select(*[F.pmod(F.col(a), F.lit(256)).alias(a) for a in "xyz"[:n]]).withColumn("m", morton).withColumn("h", V.morton2hilbert("m", n, 8))
    for r in small.withColumn("same", V.hilbert(list("xyz"[:n]), 8)).withColumn("back", V.hilbert2morton("h", n, 8)).collect():
        assert r.h == r.same and r.back == r.m


@pytest.mark.parametrize("n,bits", [(2, 5), (3, 2)])
def test_curve_is_compiled_and_keeps_nulls(spark, n, bits):
    """Folds over bits were interpreted for each row."""
    test_curve_visits_every_cell_by_single_steps(spark, n, bits)
    cells = spark.range(3).select(*[F.when(F.col("id") > 0, F.col("id")).alias(a) for a in "xyz"[:n]])
    found = cells.withColumn("h", V.hilbert(list("xyz"[:n]), bits)).withColumn("m", V.hilbert2morton("h", n, bits)).withColumn("b", V.unhilbert("h", n, bits)["y"]).withColumn("k", V.morton2hilbert("m", n, bits))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.h is None, r.b, r.h == r.k) for r in found.orderBy("x").collect()] == [(True, None, True), (False, 1, True), (False, 2, True)]


def test_peano_numbers_of_pixels(spark):
    """Each face is walked pixel by pixel, over a common edge."""
    nside = 8
    pixels = spark.range(12 * nside * nside).select(F.col("id").alias("pix")).withColumn("p", V.nest2peano("pix", nside)).withColumn("back", V.peano2nest("p", nside))
    rows = P.pix2xyf(pixels, nside, "NEST").orderBy("p").collect()
    assert [r.p for r in rows] == list(range(12 * nside * nside)) and all(r.back == r.pix for r in rows)
    assert all(a.face != b.face or abs(a.ix - b.ix) + abs(a.iy - b.iy) == 1 for a, b in zip(rows, rows[1:], strict=False))


def brute_circle(p):
    best = None
    for k in (2, 3):
        for some in combinations(range(len(p)), k):
            q = p[list(some)]
            c = q.sum(axis=0) if k == 2 else np.cross(q[1] - q[0], q[2] - q[0])
            if np.linalg.norm(c) > 1e-12:
                for s in (1, -1):
                    d = s * c / np.linalg.norm(c)
                    low = float((p @ d).min())
                    best = max(best or (-2.0,), (low, *d))
    return best


@pytest.mark.parametrize("n,spread", [(3, 0.2), (12, 0.5), (25, 0.01), (20, 1.2)])
def test_enclosing_circle(spark, n, spread):
    rng = np.random.default_rng(n)
    p = rng.normal(size=3) + spread * rng.normal(size=(n, 3)) / 2 + 2
    p /= np.linalg.norm(p, axis=1)[:, None]
    p = np.vstack([p, p[:3]])
    theta, phi, radius = C.enclosing_circle(spark.createDataFrame(p.tolist(), "x double, y double, z double").repartition(3))
    low, *center = brute_circle(p)
    assert math.cos(radius) == pytest.approx(low, abs=1e-12)
    assert np.allclose([math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)], center, atol=1e-7)


def test_enclosing_circle_of_one_point_and_helpers(spark):
    one = spark.createDataFrame([(0.0, 0.6, 0.8)] * 4, "x double, y double, z double")
    theta, phi, radius = C.enclosing_circle(one)
    assert (theta, phi, radius) == pytest.approx((math.acos(0.8), math.pi / 2, 0.0), abs=1e-9)
    with pytest.raises(ValueError):
        C.enclosing_circle(one.where("false"))
    row = spark.range(1).select(C.cosdist_zphi(F.lit(0.8), F.lit(0.0), F.lit(0.0), F.lit(math.pi)).alias("c"), C.orientation(*[tuple(map(F.lit, v)) for v in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 2.0))]).alias("o")).first()
    assert row.c == pytest.approx(-0.6) and row.o == 2.0


def _matrix(thetas, nphi, lmax):
    """Values of all real coefficients on rings, as a dense matrix, with m > 0 weighed so that lengths agree."""
    columns, names = [], []
    for m in range(lmax + 1):
        for k, v in H.legendre(m, lmax, np.array(thetas)):
            phi = 0.1 + 2 * math.pi * np.arange(nphi) / nphi
            for part in ((0,) if m == 0 else (0, 1)):
                wave = np.cos(m * phi) if part == 0 else -np.sin(m * phi)
                columns.append(np.outer(v, wave).ravel() * (1 if m == 0 else math.sqrt(2)))
                names.append((k, m, part))
    return np.array(columns).T, names


@pytest.mark.parametrize("close", [False, True])
def test_lsmr_on_rings(spark, close):
    """Rings that lie close together make the squared condition number too large for the normal equations."""
    lmax, nphi = 3, 8
    thetas = [0.9 + 0.012 * k for k in range(6)] if close else [0.3, 0.8, 1.3, 1.9, 2.4, 2.9]
    matrix, names = _matrix(thetas, nphi, lmax)
    rng = np.random.default_rng(1)
    truth = rng.normal(size=len(names))
    data = matrix @ truth
    rings = spark.createDataFrame([(i, t, nphi, 0.1) for i, t in enumerate(thetas)], "ring long, theta double, nphi long, phi0 double")
    pixels = spark.createDataFrame([(0, i, j, float(data[i * nphi + j])) for i in range(len(thetas)) for j in range(nphi)], "comp long, ring long, ipix long, value double")
    found = L.pseudo_analysis(pixels, rings, lmax, lmax, maxiter=30 if close else 20, epsilon=1e-12, conlim=1e13)
    x = np.zeros(len(names))
    for r in found.alm.collect():
        for part, v in ((0, r.re), (1, r.im)):
            if (r.l, r.m, part) in names:
                x[names.index((r.l, r.m, part))] = v * (1 if r.m == 0 else math.sqrt(2))
    assert found.residual < 1e-7 and 0 < found.iterations <= 30
    assert np.linalg.norm(matrix @ x - data) / np.linalg.norm(data) == pytest.approx(found.residual, abs=1e-9)
    if not close:
        assert found.istop in (1, 2) and np.allclose(x, truth, atol=1e-8)


def test_lsmr_stops_for_each_reason(spark):
    rings = H.rings_2d(spark, "F1", 4, 5, 0.2)
    rng = np.random.default_rng(2)
    pixels = spark.createDataFrame([(0, i, j, float(rng.normal())) for i in range(4) for j in range(5)], "comp long, ring long, ipix long, value double")
    least = L.pseudo_analysis(pixels, rings, 1, 1, maxiter=10, epsilon=1e-8)
    assert least.istop == 2 and 0.1 < least.residual <= 1 and least.quality <= 1e-8
    assert L.pseudo_analysis(pixels, rings, 1, 1, maxiter=1, epsilon=1e-14).istop == 7
    assert L.pseudo_analysis(pixels, rings, 1, 1, maxiter=9, epsilon=1e-14, conlim=1.0).istop == 3
    nothing = L.pseudo_analysis(pixels.withColumn("value", F.lit(0.0)), rings, 1, 1)
    assert (nothing.istop, nothing.iterations) == (1, 0) and all(r.re == r.im == 0 for r in nothing.alm.collect())


def test_lsmr_at_points(spark):
    lmax, rng = 2, np.random.default_rng(3)
    rows = [(0, k, m, float(rng.normal()), float(rng.normal()) if m else 0.0) for k in range(lmax + 1) for m in range(k + 1)]
    points = spark.createDataFrame([(i, float(math.acos(rng.uniform(-1, 1))), float(rng.uniform(0, 6))) for i in range(40)], "id long, theta double, phi double")
    seen = H.synthesis_general(spark.createDataFrame(rows, SCHEMA), points, lmax, lmax).join(points, "id")
    found = L.pseudo_analysis_general(seen, lmax, lmax, maxiter=12, epsilon=1e-7)
    held = {(r.l, r.m): (r.re, r.im) for r in found.alm.collect()}
    assert found.istop in (1, 2) and all(abs(held[r[1:3]][0] - r[3]) + abs(held[r[1:3]][1] - r[4]) < 1e-5 for r in rows)


def plain_filter(stages, values):
    out, state = [], [[0.0, 0.0] for _ in stages]
    for x in values:
        for (a, b, c), held in zip(stages, state, strict=True):
            y = a * x + b * held[0] + c * held[1]
            held[0], held[1] = x, y
            x = y
        out.append(x)
    return np.array(out)


def test_filter_equals_the_recurrence_however_it_is_cut():
    stages = M.noise_stages(1e-5, 0.5, 100.0, -1.6)
    values = np.random.default_rng(4).normal(size=1000)
    expect = plain_filter(stages, values)
    for cuts in ([1000], [1, 127, 128, 129, 615], [500, 0, 500]):
        state, out, at = None, [], 0
        for n in cuts:
            found, state = M.filtered(stages, values[at : at + n], state)
            out.append(found)
            at += n
        assert np.allclose(np.concatenate(out), expect, rtol=1e-10, atol=1e-12)


def _samples(n=90):
    rng = np.random.default_rng(5)
    return [(f"k{i % 3}", i, float(rng.normal()) if i % 11 else None) for i in range(n)]


NOISE = (0.3, 1e-3, 0.5, 10.0, -1.2)


def _expected(rows):
    stages = M.noise_stages(*NOISE[1:])
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        out |= {(key, at): v * NOISE[0] for (at, _), v in zip(own, plain_filter(stages, [x or 0.0 for _, x in own]), strict=True)}
    return out


def test_noise_of_a_table(spark):
    rows = _samples()
    found = M.coloured_noise(spark.createDataFrame(rows, "key string, at long, x double").repartition(4), "key", ["at"], "x", *NOISE)
    assert {(r.key, r.at): r.filtered for r in found.collect()} == pytest.approx(_expected(rows), abs=1e-12)


def test_noise_of_a_stream_cut_and_restarted(spark, tmp_path):
    """Three micro-batches, with a stop and a restart from the checkpoint after the first two, give the result of one batch."""
    rows, schema = _samples(), "key string, at long, x double"
    source, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "check"))

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        noise = coloured_noise_stream(stream, "key", ["at"], "x", *NOISE)
        query = noise.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    feed(rows[:17])
    run()
    feed(rows[17:40])
    run()
    feed(rows[40:])
    run()
    assert {(r.key, r.at): r.filtered for r in spark.read.parquet(sink).collect()} == pytest.approx(_expected(rows), abs=1e-12)
    assert spark.read.parquet(sink).count() == len(rows)
