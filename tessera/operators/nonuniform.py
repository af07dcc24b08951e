"""Fourier sums between scattered points and uniform modes, in one to three dimensions.

Points are a table with a key, coordinates and ``re, im``; modes are a long-form array. Exact forms sum every pair of a
point and a mode: modes are expanded from ranges, so no table is broadcast. ``spread`` forms work on a grid that is 1.2 to
2.5 times finer, whose kernel is chosen by measured errors for the accuracy asked for; points are spread and
interpolated tile by tile, and lines of the grid are transformed as Arrow groups, long ones in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.batches import computed
from ..functions.cplx import cis, times
from ..functions.kernels import Kernel, best_epsilon
from . import spectral
from .spreading import interpolate, spread

__all__ = ["Kernel", "Plan", "best_epsilon", "nu2u", "nu2u_real", "nu2u_spread", "periods", "u2nu", "u2nu_real", "u2nu_spread"]

Shape = Mapping[str, int]


def periods(coords: Sequence[str], periodicity: float | Sequence[float]) -> list[float]:
    given = [float(periodicity)] * len(coords) if isinstance(periodicity, (int, float)) else [float(p) for p in periodicity]
    if len(given) != len(coords) or any(p <= 0 for p in given):
        raise ValueError("one positive period for each coordinate")
    return given


def _mode(place: Column, n: int, fft_order: bool) -> Column:
    """The wave number of an index: from -n // 2 on, or in the order of a Fourier transform."""
    return F.when(place < (n + 1) // 2, place).otherwise(place - n) if fft_order else place - n // 2


def _phase(coords: Sequence[str], shape: Shape, period: Sequence[float], sign: int, fft_order: bool) -> Column:
    angle = F.lit(0.0)
    for c, (axis, n), p in zip(coords, shape.items(), period, strict=True):
        turn = _mode(F.col(axis), n, fft_order) * F.col(c) / F.lit(p)
        angle = angle + (turn - F.floor(turn)) * F.lit(sign * 2 * math.pi)
    return angle


def _with_modes(df: DataFrame, shape: Shape) -> DataFrame:
    for axis, n in shape.items():
        df = df.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return df


def nu2u(points: DataFrame, coords: Sequence[str], shape: Shape, forward: bool = True, periodicity: float | Sequence[float] = 2 * math.pi, fft_order: bool = False) -> DataFrame:
    """The modes of scattered samples, exactly: index columns, re, im."""
    sign = -1 if forward else 1
    every = _with_modes(points.select(*coords, "re", "im"), shape)
    re, im = times((F.col("re"), F.col("im")), cis(_phase(coords, shape, periods(coords, periodicity), sign, fft_order)))
    return every.groupBy(*shape).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def u2nu(modes: DataFrame, shape: Shape, points: DataFrame, coords: Sequence[str], key: str = "pid", forward: bool = True, periodicity: float | Sequence[float] = 2 * math.pi, fft_order: bool = False) -> DataFrame:
    """The values of uniform modes at scattered points, exactly: key, re, im. Modes that have no row are zero."""
    sign = -1 if forward else 1
    met = _with_modes(points.select(key, *coords), shape).join(modes.select(*shape, "re", "im"), list(shape))
    re, im = times((F.col("re"), F.col("im")), cis(_phase(coords, shape, periods(coords, periodicity), sign, fft_order)))
    found = met.groupBy(key).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return points.select(key).distinct().join(found, key, "left").fillna(0.0, ["re", "im"])


def fine_shape(shape: Shape, kernel: Kernel) -> dict[str, int]:
    return {axis: spectral.good_size(max(2 * kernel.width, math.ceil(kernel.sigma * n))) for axis, n in shape.items()}


def placed(points: DataFrame, coords: Sequence[str], fine: Shape, period: Sequence[float]) -> DataFrame:
    """Adds ``_x_`` and the axis: where each point lies in cells of the fine grid."""
    for c, (axis, n), p in zip(coords, fine.items(), period, strict=True):
        turn = F.col(c) / F.lit(p)
        points = points.withColumn(f"_x_{axis}", F.least((turn - F.floor(turn)) * F.lit(float(n)), F.lit(math.nextafter(n, 0))))
    return points


def _places(fine: Shape) -> list[str]:
    return [f"_x_{axis}" for axis in fine]


def line(df: DataFrame, axis: str, n: int, forward: bool) -> DataFrame:
    """The transform along an axis of any length."""
    return spectral.lines(df, axis, n, forward) if n <= spectral.EXACT_LENGTH else spectral.fourier(df, axis, n, forward)


def corrected(df: DataFrame, axis: str, n: int, fine: int, kernel: Kernel, to_fine: bool, fft_order: bool = False) -> DataFrame:
    """Divides by the kernel's transform along an axis and moves between the modes' index and the fine grid's; other modes go."""
    if to_fine:
        k = _mode(F.col(axis), n, fft_order)
        df = df.withColumn("_k", k.cast("long")).withColumn(axis, F.pmod("_k", F.lit(fine)).cast("long"))
    else:
        k = F.when(F.col(axis) <= fine // 2, F.col(axis)).otherwise(F.col(axis) - fine)
        df = df.withColumn("_k", k.cast("long")).where((F.col("_k") >= -(n // 2)) & (F.col("_k") < n - n // 2))
        df = df.withColumn(axis, (F.pmod("_k", F.lit(n)) if fft_order else F.col("_k") + n // 2).cast("long"))

    def factor(k: np.ndarray) -> np.ndarray:
        each, place = np.unique(k, return_inverse=True)
        return (1 / kernel.transform(each / fine))[place]

    df = computed(df, ["_k"], {"_f": "double"}, factor)
    return df.withColumns({"re": F.col("re") * F.col("_f"), "im": F.col("im") * F.col("_f")}).drop("_k", "_f")


def modes_of(grid: DataFrame, shape: Shape, fine: Shape, kernel: Kernel, forward: bool, fft_order: bool) -> DataFrame:
    """The modes of a spread grid: axis by axis transformed, cut to those asked for, and corrected."""
    for axis, n in fine.items():
        grid = corrected(line(grid, axis, n, forward), axis, shape[axis], n, kernel, False, fft_order)
    return grid.select(*shape, "re", "im")


def grid_of(modes: DataFrame, shape: Shape, fine: Shape, kernel: Kernel, forward: bool, fft_order: bool) -> DataFrame:
    """The fine grid from which points are interpolated; axes are padded one by one, so that few cells are transformed."""
    grid = modes.select(*shape, "re", "im")
    for axis, n in fine.items():
        grid = line(corrected(grid, axis, shape[axis], n, kernel, True, fft_order), axis, n, forward)
    return grid


def _kernel(epsilon: float, shape: Shape, sigma_min: float, sigma_max: float) -> Kernel:
    return kernels.chosen(epsilon, list(shape.values()), math.prod(shape.values()), sigma_min, sigma_max)


def nu2u_spread(points: DataFrame, coords: Sequence[str], shape: Shape, epsilon: float = 1e-8, forward: bool = True, periodicity: float | Sequence[float] = 2 * math.pi, fft_order: bool = False, sigma_min: float = 1.2, sigma_max: float = 2.5) -> DataFrame:
    """As ``nu2u``, to a relative accuracy of ``epsilon``."""
    kernel = _kernel(epsilon, shape, sigma_min, sigma_max)
    fine = fine_shape(shape, kernel)
    grid = spread(placed(points.select(*coords, "re", "im"), coords, fine, periods(coords, periodicity)), _places(fine), fine, kernel)
    return modes_of(grid, shape, fine, kernel, forward, fft_order)


def u2nu_spread(modes: DataFrame, shape: Shape, points: DataFrame, coords: Sequence[str], key: str = "pid", epsilon: float = 1e-8, forward: bool = True, periodicity: float | Sequence[float] = 2 * math.pi, fft_order: bool = False, sigma_min: float = 1.2, sigma_max: float = 2.5) -> DataFrame:
    """As ``u2nu``, to a relative accuracy of ``epsilon``; each row of ``points`` has its own."""
    kernel = _kernel(epsilon, shape, sigma_min, sigma_max)
    fine = fine_shape(shape, kernel)
    grid = grid_of(modes, shape, fine, kernel, forward, fft_order)
    return interpolate(grid, fine, placed(points.select(key, *coords), coords, fine, periods(coords, periodicity)), _places(fine), kernel, [key])


def nu2u_real(points: DataFrame, coords: Sequence[str], shape: Shape, epsilon: float = 1e-8, **options) -> DataFrame:
    """Index columns and value: as ``nu2u_spread`` for real samples ``value``, with the real parts of the modes."""
    held = points.select(*coords, F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return nu2u_spread(held, coords, shape, epsilon, **options).select(*shape, F.col("re").alias("value"))


def u2nu_real(modes: DataFrame, shape: Shape, points: DataFrame, coords: Sequence[str], key: str = "pid", epsilon: float = 1e-8, **options) -> DataFrame:
    """Key and value: as ``u2nu_spread`` for real modes ``value``, with the real parts of the results; the adjoint of ``nu2u_real``."""
    held = modes.select(*shape, F.col("value").alias("re"), F.lit(0.0).alias("im"))
    return u2nu_spread(held, shape, points, coords, key, epsilon, **options).select(key, F.col("re").alias("value"))


class Plan:
    """Points that are located once, for many sets of values by ``key`` or of modes. Keys are unique."""

    def __init__(self, points: DataFrame, coords: Sequence[str], shape: Shape, key: str = "pid", epsilon: float = 1e-8, periodicity: float | Sequence[float] = 2 * math.pi, fft_order: bool = False, sigma_min: float = 1.2, sigma_max: float = 2.5):
        self.shape, self.key, self.fft_order = dict(shape), key, fft_order
        self.kernel = _kernel(epsilon, shape, sigma_min, sigma_max)
        self.fine = fine_shape(shape, self.kernel)
        self.placed = placed(points.select(key, *coords), coords, self.fine, periods(coords, periodicity)).select(key, *_places(self.fine)).persist()

    def nu2u(self, values: DataFrame, forward: bool = True) -> DataFrame:
        met = self.placed.join(values.select(self.key, "re", "im"), self.key)
        return modes_of(spread(met, _places(self.fine), self.fine, self.kernel), self.shape, self.fine, self.kernel, forward, self.fft_order)

    def u2nu(self, modes: DataFrame, forward: bool = True) -> DataFrame:
        grid = grid_of(modes, self.shape, self.fine, self.kernel, forward, self.fft_order)
        return interpolate(grid, self.fine, self.placed, _places(self.fine), self.kernel, [self.key])

    def close(self) -> None:
        self.placed.unpersist()
