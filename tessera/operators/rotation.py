"""Rotations of harmonic coefficients, a sky seen by a turned beam, and least-squares analysis."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import harmonic as H
from .staging import Steps


def _bessel(x: float) -> np.ndarray:
    """Bessel functions of integer orders from 0 until they vanish: the Fourier series of exp(-i x cos t)."""
    most = int(abs(x) + 12 * abs(x) ** (1 / 3) + 40)
    size = 1 << (2 * most).bit_length()
    series = np.fft.fft(np.exp(-1j * x * np.cos(2 * math.pi * np.arange(size) / size)))[:most] / size
    return (series * 1j ** (np.arange(most) % 4)).real


def tilted(vector: np.ndarray, l: int, theta: float) -> np.ndarray:  # noqa: E741
    """The coefficients of all m from -l to l of a function turned by theta about the y axis.

    The turn is exp(theta K) with K the tridiagonal generator; the exponential is summed as its Chebyshev series, whose
    terms number about l * theta, so one l takes O(l) memory and O(l * l) steps, at any l without loss.
    """
    if l == 0:
        return vector
    m = np.arange(-l, l)
    up = np.sqrt((l - m) * (l + m + 1.0)) / 2

    def turn(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        out[1:] -= up * v[:-1]
        out[:-1] += up * v[1:]
        return out / l

    weights = _bessel(math.remainder(theta, 2 * math.pi) * l)
    before, now = vector, turn(vector)
    total = weights[0] * before + 2 * weights[1] * now
    for w in weights[2:]:
        before, now = now, 2 * turn(now) + before
        total += 2 * w * now
    return total


def rotate_alm(alm: DataFrame, psi: float, theta: float, phi: float) -> DataFrame:
    """comp, l, m, re, im of a real function turned by psi about z, then theta about y, then phi about z.

    ``alm`` holds m >= 0 (missing ones are zero). Only the coefficients are shuffled, each l and component to one place.
    """

    def run(t: pa.Table) -> pa.Table:
        l, comp = t.column("l")[0].as_py(), t.column("comp")[0].as_py()  # noqa: E741
        m = t.column("m").to_numpy()
        v = np.zeros(2 * l + 1, complex)
        np.add.at(v, l + m, (t.column("re").to_numpy() + 1j * t.column("im").to_numpy()) * np.exp(-1j * m * psi))
        every = np.arange(1, l + 1)
        v[l - every] = (-1.0) ** every * v[l + every].conj()
        out = tilted(v, l, theta)[l:] * np.exp(-1j * np.arange(l + 1) * phi)
        n = l + 1
        return pa.table({"comp": np.full(n, comp), "l": np.full(n, l), "m": np.arange(n), "re": out.real.copy(), "im": out.imag.copy()})

    comp = F.col("comp").cast("long") if "comp" in alm.columns else F.lit(0).cast("long")
    picked = alm.where("m between 0 and l").select(comp.alias("comp"), F.col("l").cast("long"), F.col("m").cast("long"), "re", "im")
    return picked.groupBy("comp", "l").applyInArrow(run, "comp long, l long, m long, re double, im double")


def beam_coefficients(sky: DataFrame, beam: DataFrame, k: int) -> DataFrame:
    """comp, l, m, re, im of the spin-k field that a beam's order k makes of a sky; comps of both are paired and added up."""
    norm = F.sqrt(4 * math.pi / (2 * F.col("l") + 1.0)) * (-1 if k else 1)
    b = beam.where((F.col("m") == k) & (F.col("l") >= k)).select(F.col("comp").alias("_pair"), "l", (F.col("re") * norm).alias("_re"), (F.col("im") * norm).alias("_im"))
    met = sky.select(F.col("comp").alias("_pair"), "l", "m", "re", "im").join(b, ["_pair", "l"])
    parts = [F.struct(F.lit(i).cast("long").alias("comp"), F.col(w).alias("w")) for i, w in enumerate(("_re", "_im")[: 2 if k else 1])]
    each = met.select("l", "m", "re", "im", F.explode(F.array(*parts)).alias("p")).select("p.comp", "l", "m", (F.col("re") * F.col("p.w")).alias("re"), (F.col("im") * F.col("p.w")).alias("im"))
    return each.groupBy("comp", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def beam_planes(sky: DataFrame, beam: DataFrame, rings: DataFrame, lmax: int, kmax: int) -> DataFrame:
    """k, comp, ring, ipix, value: for each beam order the maps whose sum over cos(k psi) and sin(k psi) is the signal."""
    planes = [H.synthesis(beam_coefficients(sky, beam, k), rings, lmax, lmax, k).withColumn("k", F.lit(k).cast("long")) for k in range(kmax + 1)]
    return reduce(DataFrame.unionByName, planes).select("k", "comp", "ring", "ipix", "value")


def _phase(k: Column | int, comp: Column) -> Column:
    """The share of a plane in the signal at the roll angle psi."""
    return F.when(k == F.lit(0), 1.0).when(comp == 0, 2 * F.cos(k * F.col("psi"))).otherwise(2 * F.sin(k * F.col("psi")))


def convolved(sky: DataFrame, beam: DataFrame, pointings: DataFrame, lmax: int, kmax: int, key: str = "id") -> DataFrame:
    """key, value: the sky's integral over the beam turned to each pointing (key, theta, phi, psi), by the exact sums."""
    rings = pointings.select(F.col(key).alias("ring"), "theta", F.col("phi").alias("phi0"), "psi")
    legs = [H.alm2leg(beam_coefficients(sky, beam, k), rings, lmax, lmax, k, ["phi0", "psi"]) for k in range(kmax + 1)]
    seen = [leg.select("ring", (H.leg_value() * _phase(F.lit(k), F.col("comp"))).alias("value")) for k, leg in enumerate(legs)]
    return reduce(DataFrame.unionByName, seen).groupBy(F.col("ring").alias(key)).agg(F.sum("value").alias("value"))


def convolved_adjoint(pointings: DataFrame, beam: DataFrame, lmax: int, kmax: int, key: str = "id") -> DataFrame:
    """comp, l, m, re, im: the adjoint of ``convolved``, from key, theta, phi, psi and value."""
    parts = []
    for k in range(kmax + 1):
        comps = F.explode(F.array(*[F.lit(i).cast("long") for i in range(2 if k else 1)]))
        spread = pointings.select(key, "theta", "phi", "psi", "value", comps.alias("comp"))
        spread = spread.withColumn("value", F.col("value") * _phase(F.lit(k), F.col("comp")))
        found = H.adjoint_synthesis_general(spread, lmax, lmax, k, key)
        norm = F.sqrt(4 * math.pi / (2 * F.col("l") + 1.0)) * (-1 if k else 1)
        b = beam.where((F.col("m") == k) & (F.col("l") >= k)).select(F.col("comp").alias("_pair"), "l", (F.col("re") * norm).alias("_re"), (F.col("im") * norm).alias("_im"))
        share = F.when(F.col("comp") == 0, F.col("_re")).otherwise(F.col("_im"))
        parts.append(found.join(b, "l").select(F.col("_pair").alias("comp"), "l", "m", (F.col("re") * share).alias("re"), (F.col("im") * share).alias("im")))
    return reduce(DataFrame.unionByName, parts).groupBy("comp", "l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _plus(a: DataFrame, b: DataFrame, scale: float, keys: Sequence[str]) -> DataFrame:
    """a + scale * b; cells that one of them lacks are zero there."""
    values = [c for c in a.columns if c not in keys]
    scaled = b.select(*keys, *[(F.col(c) * scale).alias(c) for c in values])
    return a.select(*keys, *values).unionByName(scaled).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def _square(df: DataFrame) -> float:
    """The squared length of a map, or of the coefficients of a real map, in which each m > 0 stands for two."""
    if "value" in df.columns:
        term = F.col("value") * F.col("value")
    else:
        term = F.when(F.col("m") == 0, 1.0).otherwise(2.0) * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return df.agg(F.sum(term)).first()[0] or 0.0


def least_squares(data: DataFrame, forward: Callable[[DataFrame], DataFrame], adjoint: Callable[[DataFrame], DataFrame], cells: Sequence[str], maxiter: int, epsilon: float) -> tuple[DataFrame, int, float]:
    """The coefficients whose image comes nearest to ``data``, the number of steps and the gradient left, relative to the first.

    Conjugate gradients on the normal equations. A step costs one transform each way; only two sums reach the driver.
    """
    keys = ["comp", "l", "m"]
    steps = Steps(data.sparkSession, "least-squares")
    _cut = steps.put
    rest = _cut(data.select(*cells, "value"))
    step = slope = _cut(adjoint(rest))
    x, first = step.select(*keys, F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), _square(slope)
    left, done = first, 0
    while done < maxiter and left > epsilon * epsilon * first:
        image = _cut(forward(step).select(*cells, "value"))
        size = _square(image)
        if size == 0:
            break
        x, rest = _cut(_plus(x, step, left / size, keys)), _cut(_plus(rest, image, -left / size, cells))
        slope = _cut(adjoint(rest))
        now = _square(slope)
        step, left, done = _cut(_plus(slope, step, now / left, keys)), now, done + 1
        steps.keep_only(x, rest, step)
    return x, done, math.sqrt(left / first) if first else 0.0


def pseudo_analysis(pixels: DataFrame, rings: DataFrame, lmax: int, mmax: int, spin: int = 0, maxiter: int = 20, epsilon: float = 1e-6) -> tuple[DataFrame, int, float]:
    """Least-squares coefficients of a map on any rings: the table, the number of steps and what is left of the gradient."""
    held = pixels if "comp" in pixels.columns else pixels.withColumn("comp", F.lit(0).cast("long"))
    return least_squares(held, lambda a: H.synthesis(a, rings, lmax, mmax, spin), lambda p: H.adjoint_synthesis(p, rings, lmax, mmax, spin), ["comp", "ring", "ipix"], maxiter, epsilon)


def pseudo_analysis_general(points: DataFrame, lmax: int, mmax: int, spin: int = 0, key: str = "id", maxiter: int = 20, epsilon: float = 1e-6) -> tuple[DataFrame, int, float]:
    """The same for values at any directions: key, theta, phi, value and, with spin, comp."""
    held = points if "comp" in points.columns else points.withColumn("comp", F.lit(0).cast("long"))
    places = held.select(key, "theta", "phi").distinct()
    return least_squares(held, lambda a: H.synthesis_general(a, places, lmax, mmax, spin, key), lambda p: H.adjoint_synthesis_general(p.join(places.hint("merge"), key), lmax, mmax, spin, key), ["comp", key], maxiter, epsilon)
