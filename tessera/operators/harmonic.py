"""Spherical-harmonic transforms between coefficients (l, m, re, im) and ring maps (ring, ipix, value).

Coefficients of real maps have m >= 0. Rings are a table ring, theta, nphi, phi0. The Legendre step groups by m, where
coefficients and ring angles meet and the recurrence runs over all rings of a group at once; the azimuthal step groups
by ring. So a transform shuffles numbers in proportion to its input and output, and no table of functions is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRIES = ("CC", "F1", "F2", "DH", "MW", "MWflip", "GL")


def ring_thetas(geometry: str, n: int) -> np.ndarray:
    """Colatitudes of the rings of a grid."""
    j = np.arange(n)
    if geometry == "GL":
        return np.arccos(np.polynomial.legendre.leggauss(n)[0][::-1])
    places = {"CC": j / (n - 1) if n > 1 else j, "F1": (j + 0.5) / n, "F2": (j + 1) / (n + 1), "DH": j / n, "MW": (2 * j + 1) / (2 * n - 1), "MWflip": 2 * j / (2 * n - 1)}
    return np.pi * places[geometry]


def grid_weights(geometry: str, n: int) -> np.ndarray:
    """Quadrature weights of the rings, which add up to 4 pi; exact for the polynomials that the grid's angles can hold."""
    if geometry == "GL":
        return 2 * np.pi * np.polynomial.legendre.leggauss(n)[1][::-1]
    if geometry in ("MW", "MWflip"):
        raise ValueError("these grids have no quadrature weights of this kind")
    theta = ring_thetas(geometry, n)
    if geometry == "CC":
        k = np.arange(0, n)
        share = np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 0.5, 1.0)
        series = np.where(k % 2 == 0, 2 / (1 - k.astype(float) ** 2 + (k == 1)), 0.0)
        factor = np.where((k == 0) | (k == n - 1), 0.5, 1.0) * 2 / (n - 1)
        return 2 * np.pi * share * (np.cos(np.outer(theta, k)) @ (factor * series))
    if geometry == "F1":
        k = np.arange(1, n // 2 + 1)
        return 2 * np.pi * 2 / n * (1 - 2 * (np.cos(2 * np.outer(theta, k)) @ ((1 - 0.5 * (2 * k == n)) / (4 * k**2 - 1))))
    # sine series: rings at multiples of pi / (m + 1), the pole without weight
    m = n if geometry == "F2" else n - 1
    j = np.arange(1, (m + 1) // 2 + 1)
    inner = np.pi * np.arange(1, m + 1) / (m + 1)
    w = 4 * np.sin(inner) / (m + 1) * (np.sin(np.outer(inner, 2 * j - 1)) @ (1 / (2 * j - 1)))
    return 2 * np.pi * (w if geometry == "F2" else np.r_[0.0, w])


def maximum_safe_l(geometry: str, n: int) -> int:
    return {"CC": n - 2, "DH": (n - 2) // 2, "F2": (n - 1) // 2}.get(geometry, n - 1)


def rings_2d(spark: SparkSession, geometry: str, n: int, nphi: int, phi0: float = 0.0) -> DataFrame:
    """ring, theta, nphi, phi0 of a rectangular grid."""
    rows = [(i, float(t), nphi, phi0) for i, t in enumerate(ring_thetas(geometry, n))]
    return spark.createDataFrame(rows, "ring long, theta double, nphi long, phi0 double")


#: Values of the recurrences are kept as numbers of about one times 2**(SCALE * n), n an integer for each angle.
SCALE = 400


def _power(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """x**n as a number from a half to one and a power of two, by repeated squares; 0 has the power 0."""
    base, power = np.frexp(x)
    base, power = base, power.astype(np.int64)
    out, exponent = np.ones_like(x), np.zeros(len(x), np.int64)
    while n:
        if n & 1:
            out, more = np.frexp(out * base)
            exponent = exponent + power + more
        base, more = np.frexp(base * base)
        power = 2 * power + more
        n >>= 1
    return out, np.where(out == 0, 0, exponent)


def _root(n: int) -> tuple[float, int]:
    """The square root of a whole number of any size, as a number and a power of two."""
    shift = max(0, n.bit_length() - 120) & ~1
    return math.sqrt(n >> shift), shift // 2


def _started(value: np.ndarray, exponent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """value * 2**exponent in the form of the recurrences."""
    steps = np.minimum(0, np.round(exponent / SCALE).astype(np.int64))
    return np.ldexp(value, (exponent - SCALE * steps).astype(np.int32)), steps


class _Scaled:
    """A pair of neighbours of a recurrence over l, whose values grow from far below the smallest double to about one."""

    def __init__(self, value: np.ndarray, exponent: np.ndarray):
        self.now, self.steps = _started(value, exponent)
        self.before = np.zeros_like(self.now)
        self.low = np.flatnonzero(self.steps < 0)

    def value(self) -> np.ndarray:
        if not len(self.low):
            return self.now
        out = self.now.copy()
        out[self.low] = np.where(self.steps[self.low] < -3, 0.0, np.ldexp(self.now[self.low], (SCALE * np.maximum(self.steps[self.low], -4)).astype(np.int32)))
        return out

    def move(self, following: np.ndarray) -> None:
        self.now, self.before = following, self.now
        if len(self.low):
            grown = self.low[np.abs(self.now[self.low]) > 2.0 ** (SCALE // 2)]
            if len(grown):
                self.now[grown] = np.ldexp(self.now[grown], -SCALE)
                self.before[grown] = np.ldexp(self.before[grown], -SCALE)
                self.steps[grown] += 1
                self.low = np.flatnonzero(self.steps < 0)


def legendre(m: int, lmax: int, theta: np.ndarray):
    """Yields l and the normalised associated Legendre function of (l, m) at all angles, for l from m to lmax.

    The first, of l = m, may be far too small for a double; it is kept with a power of two of its own until it has grown.
    """
    x, s = np.cos(theta), np.sin(theta)
    root, two = _root(math.comb(2 * m, m))
    power, exponent = _power(s, m)
    pair = _Scaled(power * (root * math.sqrt((2 * m + 1) / (4 * math.pi)) * (-1) ** m), exponent + two - m)
    eps = lambda l: math.sqrt((l * l - m * m) / (4.0 * l * l - 1))  # noqa: E731, E741
    for l in range(m, lmax + 1):  # noqa: E741
        yield l, pair.value()
        pair.move((x * pair.now - (eps(l) * pair.before if l > m else 0.0)) / eps(l + 1))


def spin_functions(m: int, spin: int, lmax: int, theta: np.ndarray):
    """Yields l and the functions lambda plus and minus of a positive spin."""
    c, s, x = np.cos(theta / 2), np.sin(theta / 2), np.cos(theta)
    hi, lo = max(m, spin), min(m, spin)
    root, two = _root(math.comb(2 * hi, hi - lo))
    odd = (-1) ** (m + spin)
    pairs = []
    for a, b, factor in ((c, s, (-1) ** spin * (odd if m >= spin else 1)), (s, c, odd)):
        (p, e), (q, f) = _power(a, hi + lo), _power(b, hi - lo)
        pairs.append(_Scaled(p * q * (root * factor), e + f + two))
    plus, minus = pairs
    for l in range(hi, lmax + 1):  # noqa: E741
        yield l, plus.value(), minus.value()
        t = math.sqrt(((l + 1.0) ** 2 - m * m) * ((l + 1.0) ** 2 - spin * spin))
        a, shift = (l + 1) * (2 * l + 1) / t, m * spin / (l * (l + 1.0))
        b = (l + 1.0) / l * math.sqrt((l * l - m * m) * (l * l - spin * spin * 1.0)) / t
        plus.move(a * (x - shift) * plus.now - b * plus.before)
        minus.move(a * (x + shift) * minus.now - b * minus.before)


def _spin_norm(l: int, spin: int) -> float:  # noqa: E741
    return (1 if spin % 2 else -1) * 0.5 * math.sqrt((2 * l + 1) / (4 * math.pi))


#: Rings of one m that one group holds.
RINGS_A_GROUP = 50_000


def _blocks(rings: DataFrame) -> int:
    return max(1, math.ceil(rings.count() / RINGS_A_GROUP))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("ring"), F.lit(blocks)).cast("int")


def _by_m(rings: DataFrame, mmax: int, blocks: int, keep: Sequence[str] = ()) -> DataFrame:
    return rings.select("ring", "theta", *keep, _block(blocks).alias("_block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mmax).cast("long"))).alias("m"))


def _complex(table: pa.Table) -> np.ndarray:
    return table.column("re").to_numpy() + 1j * table.column("im").to_numpy()


def _leg_table(rings: np.ndarray, m: int, values: list[np.ndarray]) -> pa.Table:
    n = len(rings)
    every = np.concatenate(values) if values else np.zeros(0, complex)
    return pa.table({"comp": np.repeat(np.arange(len(values)), n), "ring": np.tile(rings, len(values)), "m": np.full(len(every), m), "re": every.real.copy(), "im": every.imag.copy()})


def alm2leg(alm: DataFrame, rings: DataFrame, lmax: int, mmax: int, spin: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """comp, ring, m, re, im: sums over l. ``alm`` has comp too (0 for spin 0; gradient 0 and curl 1 otherwise).

    Doubles of ``rings`` named in ``keep`` are added, which spares a join where each point is a ring.
    """

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        out = legs(a, r)
        for c in keep:
            values = r.column(c).combine_chunks()
            out = out.append_column(c, pa.concat_arrays([values] * (out.num_rows // len(values))) if out.num_rows else pa.array([], pa.float64()))
        return out

    def legs(a: pa.Table, r: pa.Table) -> pa.Table:
        if not r.num_rows:
            return _leg_table(np.zeros(0, np.int64), 0, [])
        m, theta, rows = r.column("m")[0].as_py(), r.column("theta").to_numpy(), r.column("ring").to_numpy()
        held = np.zeros((2, lmax + 1), complex)
        np.add.at(held, (a.column("comp").to_numpy(), a.column("l").to_numpy()), _complex(a))
        out = [np.zeros(len(rows), complex) for _ in range(2 if spin else 1)]
        if spin == 0:
            for l, values in legendre(m, lmax, theta):  # noqa: E741
                out[0] += held[0, l] * values
        else:
            for l, plus, minus in spin_functions(m, spin, lmax, theta):  # noqa: E741
                n, g, c = _spin_norm(l, spin), held[0, l], held[1, l]
                out[0] += n * (g * (plus + minus) - 1j * c * (plus - minus))
                out[1] += n * (c * (plus + minus) + 1j * g * (plus - minus))
        return _leg_table(rows, m, out)

    comp = "comp" if "comp" in alm.columns else F.lit(0).alias("comp")
    picked = alm.where((F.col("m") <= F.col("l")) & (F.col("l") <= lmax)).select(F.col("m").cast("long"), F.col("l").cast("long"), comp, "re", "im")
    blocks = _blocks(rings)
    picked = picked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return picked.groupBy("m", "_block").cogroup(_by_m(rings, mmax, blocks, keep).groupBy("m", "_block")).applyInArrow(run, ", ".join(["comp long, ring long, m long, re double, im double", *[f"`{c}` double" for c in keep]]))


def leg2alm(leg: DataFrame, rings: DataFrame, lmax: int, spin: int = 0) -> DataFrame:
    """comp, l, m, re, im: the adjoint of ``alm2leg``, sums over rings."""
    comp = "comp" if "comp" in leg.columns else F.lit(0).cast("long").alias("comp")
    return _ring_sums(leg.select(comp, "ring", "m", "re", "im").join(rings.select("ring", "theta"), "ring"), _blocks(rings), lmax, spin)


def _ring_sums(met: DataFrame, blocks: int, lmax: int, spin: int) -> DataFrame:
    """``leg2alm`` of rows that have the theta of their ring."""

    def run(t: pa.Table) -> pa.Table:
        m, comp = t.column("m")[0].as_py(), t.column("comp").to_numpy()
        keys, place = np.unique(t.column("ring").to_numpy(), return_inverse=True)
        theta = np.zeros(len(keys))
        theta[place] = t.column("theta").to_numpy()
        held = np.zeros((2, len(keys)), complex)
        np.add.at(held, (comp, place), _complex(t))
        rows = []
        if spin == 0:
            rows = [(0, l, m, values @ held[0]) for l, values in legendre(m, lmax, theta)]  # noqa: E741
        else:
            for l, plus, minus in spin_functions(m, spin, lmax, theta):  # noqa: E741
                n, q, u = _spin_norm(l, spin), held[0], held[1]
                rows.append((0, l, m, n * ((plus + minus) @ q - 1j * ((plus - minus) @ u))))
                rows.append((1, l, m, n * ((plus + minus) @ u + 1j * ((plus - minus) @ q))))
        comp_, l_, m_, v = zip(*rows, strict=True) if rows else ([], [], [], [])
        v = np.array(v, complex)
        return pa.table({"comp": pa.array(comp_, pa.int64()), "l": pa.array(l_, pa.int64()), "m": pa.array(m_, pa.int64()), "re": v.real.copy(), "im": v.imag.copy()})

    parts = met.withColumn("_block", _block(blocks)).groupBy("m", "_block").applyInArrow(run, "comp long, l long, m long, re double, im double")
    return parts if blocks == 1 else parts.groupBy("comp", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def leg2map(leg: DataFrame, rings: DataFrame) -> DataFrame:
    """comp, ring, ipix, value; a ring of fewer pixels than modes folds them."""

    def run(t: pa.Table) -> pa.Table:
        n, phi0, m = t.column("nphi")[0].as_py(), t.column("phi0")[0].as_py(), t.column("m").to_numpy()
        values = _complex(t) * np.exp(1j * m * phi0) * np.where(m == 0, 1, 2)
        spectrum = np.zeros(n, complex)
        np.add.at(spectrum, m % n, values)
        found = (np.fft.ifft(spectrum) * n).real
        return pa.table({"comp": np.full(n, t.column("comp")[0].as_py()), "ring": np.full(n, t.column("ring")[0].as_py()), "ipix": np.arange(n), "value": found})

    met = leg.select("comp", "ring", "m", "re", "im").join(rings.select("ring", "nphi", "phi0"), "ring")
    return met.groupBy("comp", "ring").applyInArrow(run, "comp long, ring long, ipix long, value double")


def map2leg(pixels: DataFrame, rings: DataFrame, mmax: int) -> DataFrame:
    """comp, ring, m, re, im: the adjoint of ``leg2map`` up to the factor of two, plain sums over each ring."""

    def run(t: pa.Table) -> pa.Table:
        n, phi0 = t.column("nphi")[0].as_py(), t.column("phi0")[0].as_py()
        held = np.zeros(n)
        np.add.at(held, t.column("ipix").to_numpy(), t.column("value").to_numpy())
        m = np.arange(mmax + 1)
        found = np.fft.fft(held)[m % n] * np.exp(-1j * m * phi0)
        return pa.table({"comp": np.full(len(m), t.column("comp")[0].as_py()), "ring": np.full(len(m), t.column("ring")[0].as_py()), "m": m, "re": found.real.copy(), "im": found.imag.copy()})

    comp = "comp" if "comp" in pixels.columns else F.lit(0).cast("long").alias("comp")
    met = pixels.select(comp, "ring", "ipix", F.coalesce("value", F.lit(0.0)).alias("value")).join(rings.select("ring", "nphi", "phi0"), "ring")
    return met.groupBy("comp", "ring").applyInArrow(run, "comp long, ring long, m long, re double, im double")


def synthesis(alm: DataFrame, rings: DataFrame, lmax: int, mmax: int, spin: int = 0) -> DataFrame:
    """The map of coefficients on any rings: comp, ring, ipix, value."""
    return leg2map(alm2leg(alm, rings, lmax, mmax, spin), rings)


def adjoint_synthesis(pixels: DataFrame, rings: DataFrame, lmax: int, mmax: int, spin: int = 0) -> DataFrame:
    return leg2alm(map2leg(pixels, rings, mmax), rings, lmax, spin)


def synthesis_2d(alm: DataFrame, geometry: str, n: int, nphi: int, lmax: int, mmax: int, spin: int = 0, phi0: float = 0.0) -> DataFrame:
    return synthesis(alm, rings_2d(alm.sparkSession, geometry, n, nphi, phi0), lmax, mmax, spin)


def _circle(geometry: str, n: int) -> tuple[int, float]:
    """Points of the full circle that the rings are part of, and the first one's place in steps."""
    return {"CC": (2 * n - 2, 0.0), "F1": (2 * n, 0.5), "MW": (2 * n - 1, 0.5), "MWflip": (2 * n - 1, 0.0)}[geometry]


def _least_rings(geometry: str, lmax: int) -> int:
    """Rings from which the quadrature weights alone are exact."""
    return {"GL": lmax + 1, "CC": 2 * lmax + 2, "DH": 2 * lmax + 2, "MW": 1 << 62, "MWflip": 1 << 62}.get(geometry, 2 * lmax + 1)


def resample_theta(leg: DataFrame, geometry: str, n: int, lmax: int, spin: int = 0, adjoint: bool = False) -> DataFrame:
    """Values on the rings of a grid as values on 2 * lmax + 2 equidistant rings with both poles, or the adjoint of that.

    Along a meridian and its continuation beyond the pole, which has the sign (-1)**(m + spin), a band-limited function is a
    trigonometric polynomial of degree lmax; one m at a time goes through two fast transforms.
    """
    (size, off), n_fine = _circle(geometry, n), 2 * lmax + 2
    fine = 2 * n_fine - 2
    if size < 2 * lmax + 1:
        raise ValueError("the grid has too few rings for these coefficients")
    twin = (size - np.arange(size) - round(2 * off)) % size
    k = np.fft.fftfreq(size, 1 / size).round().astype(np.int64)
    held = np.abs(k) <= lmax
    k, turn = k[held], np.exp(-2j * math.pi * off / size * k[held])

    def run(t: pa.Table) -> pa.Table:
        m = t.column("m")[0].as_py()
        sign = -1.0 if (m + spin) % 2 else 1.0
        given = np.zeros(n_fine if adjoint else n, complex)
        np.add.at(given, t.column("ring").to_numpy(), _complex(t))
        if adjoint:
            spectrum = np.zeros(size, complex)
            spectrum[held] = np.fft.fft(np.r_[given, np.zeros(fine - n_fine)])[k] * turn.conj()
            circle = np.fft.ifft(spectrum)
            found = circle[:n].copy()
            np.add.at(found, twin[n:], sign * circle[n:])
        else:
            circle = np.r_[given, sign * given[twin[n:]]]
            spectrum = np.zeros(fine, complex)
            spectrum[k] = np.fft.fft(circle)[held] / size * turn
            found = (np.fft.ifft(spectrum) * fine)[:n_fine]
        return _leg_table(np.arange(len(found)), m, [found]).set_column(0, "comp", pa.array(np.full(len(found), t.column("comp")[0].as_py())))

    picked = leg.select("comp", "ring", "m", "re", "im")
    return picked.groupBy("comp", "m").applyInArrow(run, "comp long, ring long, m long, re double, im double")


def analysis_2d(pixels: DataFrame, geometry: str, n: int, nphi: int, lmax: int, mmax: int, spin: int = 0, phi0: float = 0.0) -> DataFrame:
    """Coefficients of a band-limited map.

    By quadrature where the weights are exact to 2 * lmax; CC, F1 and MW grids of fewer rings (lmax + 2 for CC, lmax + 1 for
    the others) are resampled along the meridians first.
    """
    _check_grid(geometry, n, nphi, lmax, mmax)
    rings = rings_2d(pixels.sparkSession, geometry, n, nphi, phi0)
    if n >= _least_rings(geometry, lmax):
        return adjoint_synthesis(_weighed(pixels, geometry, n, nphi), rings, lmax, mmax, spin)
    dense = resample_theta(map2leg(pixels, rings, mmax), geometry, n, lmax, spin)
    return leg2alm(_weighed(dense, "CC", 2 * lmax + 2, nphi), rings_2d(pixels.sparkSession, "CC", 2 * lmax + 2, nphi), lmax, spin)


def _check_grid(geometry: str, n: int, nphi: int, lmax: int, mmax: int) -> None:
    least = _least_rings(geometry, lmax)
    if n < min(least, {"CC": lmax + 2, "F1": lmax + 1, "MW": lmax + 1, "MWflip": lmax + 1}.get(geometry, least)) or nphi < 2 * mmax + 1:
        raise ValueError("the grid has too few rings or pixels for these coefficients")


def _weighed(values: DataFrame, geometry: str, n: int, nphi: int) -> DataFrame:
    weights = values.sparkSession.createDataFrame([(i, float(w) / nphi) for i, w in enumerate(grid_weights(geometry, n))], "ring long, w double")
    scaled = {c: F.col(c) * F.col("w") for c in ("value", "re", "im") if c in values.columns}
    return values.join(weights, "ring").withColumns(scaled).drop("w")


def adjoint_synthesis_2d(pixels: DataFrame, geometry: str, n: int, nphi: int, lmax: int, mmax: int, spin: int = 0, phi0: float = 0.0) -> DataFrame:
    return adjoint_synthesis(pixels, rings_2d(pixels.sparkSession, geometry, n, nphi, phi0), lmax, mmax, spin)


def adjoint_analysis_2d(alm: DataFrame, geometry: str, n: int, nphi: int, lmax: int, mmax: int, spin: int = 0, phi0: float = 0.0) -> DataFrame:
    """The adjoint of ``analysis_2d``: its steps the other way round."""
    _check_grid(geometry, n, nphi, lmax, mmax)
    if n >= _least_rings(geometry, lmax):
        return _weighed(synthesis_2d(alm, geometry, n, nphi, lmax, mmax, spin, phi0), geometry, n, nphi)
    spark, n_fine = alm.sparkSession, 2 * lmax + 2
    dense = _weighed(alm2leg(alm, rings_2d(spark, "CC", n_fine, nphi), lmax, mmax, spin), "CC", n_fine, nphi)
    return leg2map(resample_theta(dense, geometry, n, lmax, spin, adjoint=True), rings_2d(spark, geometry, n, nphi, phi0))


def _sloped(alm: DataFrame) -> DataFrame:
    """Gradient coefficients of spin 1: times sqrt(l (l + 1))."""
    slope = F.sqrt(F.col("l") * (F.col("l") + 1.0))
    return alm.where("l > 0").select(F.lit(0).cast("long").alias("comp"), "l", "m", (F.col("re") * slope).alias("re"), (F.col("im") * slope).alias("im"))


def alm2leg_deriv1(alm: DataFrame, rings: DataFrame, lmax: int, mmax: int) -> DataFrame:
    """``alm2leg`` of the derivatives: comp 0 along theta, comp 1 along phi over sin(theta)."""
    return alm2leg(_sloped(alm), rings, lmax, mmax, 1)


def synthesis_deriv1(alm: DataFrame, rings: DataFrame, lmax: int, mmax: int) -> DataFrame:
    """Maps of both derivatives of a scalar map: comp 0 along theta, comp 1 along phi over sin(theta)."""
    return leg2map(alm2leg_deriv1(alm, rings, lmax, mmax), rings)


def synthesis_2d_deriv1(alm: DataFrame, geometry: str, n: int, nphi: int, lmax: int, mmax: int, phi0: float = 0.0) -> DataFrame:
    return synthesis_deriv1(alm, rings_2d(alm.sparkSession, geometry, n, nphi, phi0), lmax, mmax)


def _as_rings(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col(key).alias("ring"), "theta", F.col("phi").alias("phi0"))


def leg_value() -> Column:
    """The share of a row of ``alm2leg`` in the value at phi0."""
    angle = F.col("m") * F.col("phi0")
    return F.when(F.col("m") == 0, 1.0).otherwise(2.0) * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))


def synthesis_general(alm: DataFrame, points: DataFrame, lmax: int, mmax: int, spin: int = 0, key: str = "id") -> DataFrame:
    """comp, key, value at any directions, by the exact sums: each is a ring of its own, whose phases are columns."""
    met = alm2leg(alm, _as_rings(points, key), lmax, mmax, spin, ["phi0"])
    return met.groupBy("comp", F.col("ring").alias(key)).agg(F.sum(leg_value()).alias("value"))


def adjoint_synthesis_general(points: DataFrame, lmax: int, mmax: int, spin: int = 0, key: str = "id") -> DataFrame:
    """The adjoint of ``synthesis_general``; ``points`` holds key, theta, phi, value and, with spin, comp."""
    comp = "comp" if "comp" in points.columns else F.lit(0).cast("long").alias("comp")
    every = points.select(comp, F.col(key).alias("ring"), "theta", "phi", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mmax).cast("long"))).alias("m"))
    angle = F.col("m") * F.col("phi")
    return _ring_sums(every.select("comp", "ring", "m", "theta", (F.col("value") * F.cos(angle)).alias("re"), (-F.col("value") * F.sin(angle)).alias("im")), _blocks(points), lmax, spin)


def to_full(alm: DataFrame, spin: int = 0) -> DataFrame:
    """Adds the coefficients of negative m: (-1)**(m + spin) times the conjugate."""
    sign = F.when((F.col("m") + spin) % 2 == 0, 1.0).otherwise(-1.0)
    rest = [c for c in alm.columns if c not in ("m", "re", "im")]
    mirrored = alm.where("m > 0").select(*rest, (-F.col("m")).alias("m"), (sign * F.col("re")).alias("re"), (-sign * F.col("im")).alias("im"))
    return alm.select(*rest, "m", "re", "im").unionByName(mirrored)


def from_full(flm: DataFrame, spin: int = 0) -> DataFrame:
    """The inverse of ``to_full``: coefficients of m >= 0, each the mean of its own value and of what its mirror image says."""
    sign = F.when((F.col("m") + spin) % 2 == 0, 1.0).otherwise(-1.0)
    rest = [c for c in flm.columns if c not in ("m", "re", "im")]
    mirrored = flm.where("m < 0").select(*rest, (-F.col("m")).alias("m"), (sign * F.col("re")).alias("re"), (-sign * F.col("im")).alias("im"))
    both = flm.where("m >= 0").select(*rest, "m", "re", "im").unionByName(mirrored)
    return both.groupBy(*rest, "m").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
