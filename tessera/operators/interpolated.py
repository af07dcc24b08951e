"""Synthesis at any directions and a sky seen by a turned beam, by interpolation from Fourier tables of the doubled sphere.

Along a meridian and its continuation beyond the pole a band-limited function is a trigonometric polynomial, so the whole
sphere is a two-dimensional one in theta and phi; with the roll angle psi of a beam, it has three dimensions. Its
coefficients are few, (2 lmax + 1) by as many m, and come from rings by one short transform for each m. Values at points
are then spread sums: the table goes to a finer grid, and points take their values from the tiles they lie in. Only
tiles that hold points get their cells, and no group belongs to a point.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from . import harmonic as H
from . import nonuniform as N
from .harmonic import _complex
from .rotation import beam_coefficients
from .spreading import interpolate, spread

TURN = 2 * math.pi


def _circle(lmax: int) -> tuple[int, int]:
    """Rings from pole to pole that hold a degree, and the points of the circle they are half of."""
    return lmax + 2, 2 * lmax + 2


def theta_table(leg: DataFrame, lmax: int, spin: int) -> DataFrame:
    """comp, kt, m, re, im: Fourier coefficients along the meridians, kt - lmax their wave number, of values on ``_circle`` rings."""
    n, size = _circle(lmax)
    k = np.arange(-lmax, lmax + 1)

    def run(t: pa.Table) -> pa.Table:
        m, comp = t.column("m")[0].as_py(), t.column("comp")[0].as_py()
        given = np.zeros(n, complex)
        np.add.at(given, t.column("ring").to_numpy(), _complex(t))
        found = np.fft.fft(np.r_[given, (-1.0 if (m + spin) % 2 else 1.0) * given[-2:0:-1]])[k] / size
        return pa.table({"comp": np.full(len(k), comp), "kt": k + lmax, "m": np.full(len(k), m), "re": found.real.copy(), "im": found.imag.copy()})

    return leg.select("comp", "ring", "m", "re", "im").groupBy("comp", "m").applyInArrow(run, "comp long, kt long, m long, re double, im double")


def theta_table_adjoint(table: DataFrame, lmax: int, spin: int) -> DataFrame:
    """comp, ring, m, re, im: the adjoint of ``theta_table``."""
    n, size = _circle(lmax)

    def run(t: pa.Table) -> pa.Table:
        m, comp = t.column("m")[0].as_py(), t.column("comp")[0].as_py()
        spectrum = np.zeros(size, complex)
        np.add.at(spectrum, (t.column("kt").to_numpy() - lmax) % size, _complex(t))
        circle = np.fft.ifft(spectrum)
        found = circle[:n].copy()
        found[1:-1] += (-1.0 if (m + spin) % 2 else 1.0) * circle[:n - 1:-1]
        return pa.table({"comp": np.full(n, comp), "ring": np.arange(n), "m": np.full(n, m), "re": found.real.copy(), "im": found.imag.copy()})

    return table.select("comp", "kt", "m", "re", "im").groupBy("comp", "m").applyInArrow(run, "comp long, ring long, m long, re double, im double")


def _rings(spark, lmax: int) -> DataFrame:
    return H.rings_2d(spark, "CC", _circle(lmax)[0], 1)


def _turned(angle, sign: int = 1) -> tuple:
    """The value re, im times exp(+-i angle)."""
    c, s = F.cos(angle), sign * F.sin(angle)
    return F.col("re") * c - F.col("im") * s, F.col("re") * s + F.col("im") * c


def synthesis_general(alm: DataFrame, points: DataFrame, lmax: int, mmax: int, spin: int = 0, key: str = "id", epsilon: float = 1e-7, sigma_min: float = 1.2, sigma_max: float = 2.5) -> DataFrame:
    """comp, key, value at the directions of ``points`` (key, theta, phi), to a relative accuracy of ``epsilon``."""
    leg = H.alm2leg(alm, _rings(alm.sparkSession, lmax), lmax, mmax, spin)
    twice = F.when(F.col("m") == 0, 1.0).otherwise(2.0)
    table = theta_table(leg, lmax, spin).select("comp", "kt", F.col("m").alias("km"), (F.col("re") * twice).alias("re"), (F.col("im") * twice).alias("im"))
    middle, shape, out = (mmax + 1) // 2, {"kt": 2 * lmax + 1, "km": mmax + 1}, []
    for comp in range(2 if spin else 1):
        modes = table.where(F.col("comp") == comp)
        seen = N.u2nu_spread(modes, shape, points.withColumn("_key", F.struct(F.col(key).alias("k"), F.col("phi").alias("p"))), ["theta", "phi"], "_key", epsilon, False, TURN, False, sigma_min, sigma_max)
        value, _ = _turned(F.col("_key.p") * middle)
        out.append(seen.select(F.lit(comp).cast("long").alias("comp"), F.col("_key.k").alias(key), value.alias("value")))
    return reduce(DataFrame.unionByName, out)


def adjoint_synthesis_general(points: DataFrame, lmax: int, mmax: int, spin: int = 0, epsilon: float = 1e-7, sigma_min: float = 1.2, sigma_max: float = 2.5) -> DataFrame:
    """comp, l, m, re, im: the adjoint, from theta, phi, value and, with spin, comp."""
    held = points if "comp" in points.columns else points.withColumn("comp", F.lit(0).cast("long"))
    middle, shape, out = (mmax + 1) // 2, {"kt": 2 * lmax + 1, "km": mmax + 1}, []
    for comp in range(2 if spin else 1):
        turned = held.where(F.col("comp") == comp).select("theta", "phi", (F.col("value") * F.cos(F.col("phi") * middle)).alias("re"), (-F.col("value") * F.sin(F.col("phi") * middle)).alias("im"))
        modes = N.nu2u_spread(turned, ["theta", "phi"], shape, epsilon, True, TURN, False, sigma_min, sigma_max)
        out.append(modes.select(F.lit(comp).cast("long").alias("comp"), "kt", F.col("km").alias("m"), "re", "im"))
    leg = theta_table_adjoint(reduce(DataFrame.unionByName, out), lmax, spin)
    return H.leg2alm(leg, _rings(points.sparkSession, lmax), lmax, spin)


class Convolver:
    """A sky seen by a beam turned to many pointings (theta, phi, psi), by interpolation from a cube of the three angles.

    ``cube`` holds what any pointing can see, as long as the sky and beam stay; ``interpol`` reads it at pointings and
    ``deinterpol`` adds values at pointings up in one; ``coefficients`` brings that back to a sky's coefficients.
    """

    AXES = ("kt", "km", "kp")

    def __init__(self, lmax: int, kmax: int, epsilon: float = 1e-7, npoints: int = 1_000_000, sigma_min: float = 1.2, sigma_max: float = 2.5):
        if kmax > lmax or lmax < 0:
            raise ValueError("the beam's order must not exceed the degree")
        self.lmax, self.kmax = lmax, kmax
        self.shape = dict(zip(self.AXES, (2 * lmax + 1, 2 * lmax + 1, kmax + 1), strict=True))
        self.kernel = kernels.chosen(epsilon, list(self.shape.values()), npoints, sigma_min, sigma_max)
        self.fine = N.fine_shape(self.shape, self.kernel)
        self.middle = (kmax + 1) // 2

    @property
    def n_theta(self) -> int:
        """Cells of the full circle along theta."""
        return self.fine["kt"]

    @property
    def n_phi(self) -> int:
        return self.fine["km"]

    @property
    def n_psi(self) -> int:
        return self.fine["kp"]

    def patch(self, theta_low: float, theta_high: float, phi_low: float, phi_high: float) -> tuple[tuple[int, int], tuple[int, int]]:
        """First and last cell along theta and phi that pointings within these angles touch; cells wrap around."""
        reach = self.kernel.width / 2
        cells = lambda low, high, n: (math.ceil(low / TURN * n - reach), math.floor(high / TURN * n + reach))
        return cells(theta_low, theta_high, self.n_theta), cells(phi_low, phi_high, self.n_phi)

    def within(self, cube: DataFrame, patch: tuple[tuple[int, int], tuple[int, int]]) -> DataFrame:
        """The cells of a cube that lie in a patch."""
        inside = F.lit(True)
        for axis, n, (low, high) in zip(self.AXES, (self.n_theta, self.n_phi), patch, strict=False):
            inside = inside & (F.pmod(F.col(axis) - low, F.lit(n)) <= high - low)
        return cube.where(inside)

    def plane_table(self, sky: DataFrame, beam: DataFrame, k: int) -> DataFrame:
        """comp, kt, m, re, im: the Fourier table of the spin-k maps that the beam's order k makes of the sky."""
        alm = beam_coefficients(sky, beam, k)
        return theta_table(H.alm2leg(alm, _rings(sky.sparkSession, self.lmax), self.lmax, self.lmax, k), self.lmax, k)

    def cube(self, sky: DataFrame, beam: DataFrame) -> DataFrame:
        """kt, km, kp, re, im: the cells of the three angles, for ``interpol``."""
        parts = []
        for k in range(self.kmax + 1):
            times = 1.0 if k == 0 else 2.0  # the other order is the conjugate
            plane = self.plane_table(sky, beam, k)
            # comp 0 less i times comp 1; a real map's negative m are the conjugates
            re, im = F.when(F.col("comp") == 0, F.col("re")).otherwise(F.col("im")), F.when(F.col("comp") == 0, F.col("im")).otherwise(-F.col("re"))
            there = plane.select("kt", (F.col("m") + self.lmax).alias("km"), (re * times).alias("re"), (im * times).alias("im"))
            re, im = F.when(F.col("comp") == 0, F.col("re")).otherwise(-F.col("im")), F.when(F.col("comp") == 0, -F.col("im")).otherwise(-F.col("re"))
            back = plane.where("m > 0").select((F.lit(2 * self.lmax) - F.col("kt")).alias("kt"), (F.lit(self.lmax) - F.col("m")).alias("km"), (re * times).alias("re"), (im * times).alias("im"))
            parts.append(there.unionByName(back).withColumn("kp", F.lit(k).cast("long")))
        modes = reduce(DataFrame.unionByName, parts).groupBy(*self.AXES).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        return N.grid_of(modes, self.shape, self.fine, self.kernel, False, False)

    def _placed(self, pointings: DataFrame) -> DataFrame:
        return N.placed(pointings, ["theta", "phi", "psi"], self.fine, [TURN] * 3)

    def interpol(self, cube: DataFrame, pointings: DataFrame, key: str = "id") -> DataFrame:
        """key, value for each row of ``pointings`` (key, theta, phi, psi)."""
        seen = interpolate(cube, self.fine, self._placed(pointings.select(key, "theta", "phi", "psi")), [f"_x_{a}" for a in self.AXES], self.kernel, [key, "psi"])
        value, _ = _turned(F.col("psi") * self.middle)
        return seen.select(key, value.alias("value"))

    def deinterpol(self, pointings: DataFrame, cube: DataFrame | None = None) -> DataFrame:
        """The adjoint: values at pointings (theta, phi, psi, value) as a cube, added to another one if given."""
        angle = F.col("psi") * self.middle
        turned = self._placed(pointings).select(*[f"_x_{a}" for a in self.AXES], (F.col("value") * F.cos(angle)).alias("re"), (-F.col("value") * F.sin(angle)).alias("im"))
        found = spread(turned, [f"_x_{a}" for a in self.AXES], self.fine, self.kernel)
        return found if cube is None else found.unionByName(cube.select(*found.columns)).groupBy(*self.AXES).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def coefficients(self, cube: DataFrame, beam: DataFrame) -> DataFrame:
        """comp, l, m, re, im: the adjoint of ``cube``, for the sky's coefficients."""
        modes = N.modes_of(cube, self.shape, self.fine, self.kernel, True, False)
        # comp 0 gets half of g and of the conjugate of its mirror image; comp 1 of i times g and -i times that
        pair = lambda c, x, y: F.struct(F.lit(c).cast("long").alias("comp"), (x / 2).alias("re"), (y / 2).alias("im"))
        re, im, every = F.col("re"), F.col("im"), []
        for own, kt, m, both in (
            (F.col("km") >= self.lmax, F.col("kt"), F.col("km") - self.lmax, F.array(pair(0, re, im), pair(1, -im, re))),
            (F.col("km") <= self.lmax, 2 * self.lmax - F.col("kt"), self.lmax - F.col("km"), F.array(pair(0, re, -im), pair(1, -im, -re))),
        ):
            held = modes.where(own).select("kp", kt.cast("long").alias("kt"), m.cast("long").alias("m"), F.explode(both).alias("e"))
            every.append(held.select("kp", "kt", "m", "e.comp", "e.re", "e.im"))
        table = reduce(DataFrame.unionByName, every)
        parts = []
        for k in range(self.kmax + 1):
            leg = theta_table_adjoint(table.where((F.col("kp") == k) & (F.col("comp") < (2 if k else 1))), self.lmax, k)
            found = H.leg2alm(leg, _rings(cube.sparkSession, self.lmax), self.lmax, k)
            norm = F.sqrt(4 * math.pi / (2 * F.col("l") + 1.0)) * (-2.0 if k else 1.0)
            b = beam.where((F.col("m") == k) & (F.col("l") >= k)).select(F.col("comp").alias("_pair"), "l", (F.col("re") * norm).alias("_re"), (F.col("im") * norm).alias("_im"))
            weight = F.when(F.col("comp") == 0, F.col("_re")).otherwise(F.col("_im"))
            parts.append(found.join(b, "l").select(F.col("_pair").alias("comp"), "l", "m", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im")))
        return reduce(DataFrame.unionByName, parts).groupBy("comp", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def convolved(sky: DataFrame, beam: DataFrame, pointings: DataFrame, lmax: int, kmax: int, key: str = "id", epsilon: float = 1e-7, **options) -> DataFrame:
    """key, value: as ``rotation.convolved``, to a relative accuracy of ``epsilon``."""
    plan = Convolver(lmax, kmax, epsilon, **options)
    return plan.interpol(plan.cube(sky, beam), pointings, key)


def convolved_adjoint(pointings: DataFrame, beam: DataFrame, lmax: int, kmax: int, epsilon: float = 1e-7, **options) -> DataFrame:
    """comp, l, m, re, im: as ``rotation.convolved_adjoint``."""
    plan = Convolver(lmax, kmax, epsilon, **options)
    return plan.coefficients(plan.deinterpol(pointings), beam)
