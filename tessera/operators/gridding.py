"""Images of interferometer visibilities and back, as sums over visibilities and pixels.

Baselines are row, u, v, w in metres; channels chan, freq; visibilities row, chan, re, im and optionally wgt and mask;
images ix, iy, value. The phase of a pixel at (x, y) is freq / c * (u x + v y - w (n - 1)), n = sqrt(1 - x**2 - y**2).
The exact forms expand pixels from ranges beside the visibilities, or visibilities beside the pixels of a facet, and
sum before the shuffle. The spread forms treat w as a third axis: visibilities are spread, tile by tile, onto planes of equal
w, each plane is transformed, turned by its own phase over the image, and planes are added up; what is shuffled is in
proportion to the visibilities and to planes times cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.batches import computed
from ..functions.cplx import times
from .nonuniform import corrected, fine_shape, line
from .spreading import interpolate, spread

#: Fixed value: the speed of light in metres a second.
LIGHT = 299_792_458.0


def checked_channels(channels: DataFrame) -> DataFrame:
    """The channels, if their frequencies are positive and rise with the channel's number."""
    from pyspark.sql import Window

    before = F.lag("freq").over(Window.partitionBy(F.lit(0)).orderBy("chan"))
    bad = channels.withColumn("_b", before).where((F.col("freq") <= 0) | (F.col("freq") <= F.col("_b")))
    if not bad.isEmpty():
        raise ValueError("frequencies must be positive and rise")
    return channels


def wavelengths(baselines: DataFrame, channels: DataFrame, flip_u: bool = False, flip_v: bool = False, flip_w: bool = False) -> DataFrame:
    """row, chan and u, v, w in wavelengths. Channels are a short table beside many baselines."""
    scale = F.col("freq") / LIGHT
    sign = lambda flip: -1.0 if flip else 1.0
    return baselines.crossJoin(channels).select("row", "chan", *[(F.col(c) * scale * sign(f)).alias(c) for c, f in (("u", flip_u), ("v", flip_v), ("w", flip_w))])


def _sky(npix: tuple[int, int], pixsize: tuple[float, float], center: tuple[float, float], wgridding: bool) -> tuple[Column, Column, Column]:
    """x, y and n - 1 of the pixel (ix, iy)."""
    x = (F.col("ix") - npix[0] / 2) * pixsize[0] + center[0]
    y = (F.col("iy") - npix[1] / 2) * pixsize[1] + center[1]
    r = x * x + y * y
    return x, y, -r / (F.sqrt(1 - r) + 1) if wgridding else F.lit(0.0)


def _turns(x: Column, y: Column, nm1: Column) -> Column:
    turn = F.col("u") * x + F.col("v") * y - F.col("w") * nm1
    return (turn - F.floor(turn)) * F.lit(2 * math.pi)


def _pixels(df: DataFrame, npix: tuple[int, int]) -> DataFrame:
    if npix[0] % 2 or npix[1] % 2 or min(npix) < 2:
        raise ValueError("images have an even number of pixels along both axes")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return df.withColumn("ix", each(npix[0])).withColumn("iy", each(npix[1]))


def used(vis: DataFrame) -> DataFrame:
    """row, chan, re, im of visibilities that are not masked and weigh something, times their weight."""
    out = vis.where("mask") if "mask" in vis.columns else vis
    if "wgt" in vis.columns:
        out = out.where("wgt <> 0").withColumn("re", F.col("re") * F.col("wgt")).withColumn("im", F.col("im") * F.col("wgt"))
    return out.select("row", "chan", "re", "im")


def _shares(vis: DataFrame) -> DataFrame:
    """row, chan, _g: the weight of each visibility that is not masked."""
    flags = vis.select("row", "chan", *[c for c in ("wgt", "mask") if c in vis.columns])
    return used(flags.withColumn("re", F.lit(1.0)).withColumn("im", F.lit(0.0))).select("row", "chan", F.col("re").alias("_g"))


def vis2dirty(baselines: DataFrame, channels: DataFrame, vis: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], wgridding: bool = True, divide_by_n: bool = True, center: tuple[float, float] = (0.0, 0.0), **flips: bool) -> DataFrame:
    """ix, iy, value: the image of the visibilities, exactly."""
    x, y, nm1 = _sky(npix, pixsize, center, wgridding)
    every = _pixels(used(vis).join(wavelengths(baselines, channels, **flips), ["row", "chan"]), npix)
    angle = _turns(x, y, nm1)
    value = F.sum(F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))
    image = every.groupBy("ix", "iy").agg(value.alias("value"))
    return image.withColumn("value", F.col("value") / (nm1 + 1)) if wgridding and divide_by_n else image


def dirty2vis(baselines: DataFrame, channels: DataFrame, image: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], vis: DataFrame | None = None, wgridding: bool = True, divide_by_n: bool = True, center: tuple[float, float] = (0.0, 0.0), **flips: bool) -> DataFrame:
    """row, chan, re, im: the adjoint. With ``vis`` only its unmasked rows are predicted, times their weight; all others are zero."""
    x, y, nm1 = _sky(npix, pixsize, center, wgridding)
    value = F.col("value") / (nm1 + 1) if wgridding and divide_by_n else F.col("value")
    where = wavelengths(baselines, channels, **flips)
    asked = where
    if vis is not None:
        asked = where.join(_shares(vis), ["row", "chan"])
    else:
        asked = where.withColumn("_g", F.lit(1.0))
    angle = _turns(x, y, nm1)
    met = _pixels(asked, npix).join(image.select("ix", "iy", "value"), ["ix", "iy"])
    sums = met.groupBy("row", "chan").agg(F.sum(F.col("_g") * value * F.cos(angle)).alias("re"), F.sum(-F.col("_g") * value * F.sin(angle)).alias("im"))
    return where.select("row", "chan").join(sums, ["row", "chan"], "left").fillna(0.0, ["re", "im"])


@dataclass(frozen=True)
class Stack:
    """Planes of equal w and the grids on them, for an image and the range of w of some visibilities."""

    npix: tuple[int, int]
    pixsize: tuple[float, float]
    center: tuple[float, float]
    wgridding: bool
    kernel: kernels.Kernel
    fine: dict[str, int]
    low: float
    step: float
    middle: float

    @staticmethod
    def of(where: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], epsilon: float, wgridding: bool, center: tuple[float, float], sigma_min: float, sigma_max: float) -> Stack:
        """``where`` holds the w of the visibilities, of which only the least and the largest come to the driver."""
        if npix[0] % 2 or npix[1] % 2 or min(npix) < 2:
            raise ValueError("images have an even number of pixels along both axes")
        kernel = kernels.chosen(epsilon / 2, [*npix, 8][: 3 if wgridding else 2], math.prod(npix), sigma_min, sigma_max)
        fine = fine_shape({"iu": npix[0], "iv": npix[1]}, kernel)
        if not wgridding:
            return Stack(npix, pixsize, center, False, kernel, fine, 0.0, 1.0, 0.0)
        xs, ys = (np.abs((np.array([0, n / 2, n - 1]) - n / 2) * p + c) for n, p, c in zip(npix, pixsize, center, strict=True))
        inside = [min(0.0 if lo <= 0 <= hi else min(abs(lo), abs(hi)) for lo, hi in [(c - n / 2 * p, c + (n / 2 - 1) * p)]) for n, p, c in zip(npix, pixsize, center, strict=True)]
        far, near = xs.max() ** 2 + ys.max() ** 2, inside[0] ** 2 + inside[1] ** 2
        if far > 1:
            raise ValueError("the image reaches beyond the horizon; use the exact form")
        depth = lambda r: -r / (math.sqrt(1 - r) + 1)
        found = where.agg(F.min("w"), F.max("w")).first()
        low, high = (float(v or 0.0) for v in found)
        step = 1 / (kernel.sigma * max(depth(near) - depth(far), 1e-9))
        planes = math.floor((high - low) / step) + 2 * kernel.width + 2
        return Stack(npix, pixsize, center, True, kernel, fine | {"ip": planes}, low, step, (depth(near) + depth(far)) / 2)

    def place(self, where: DataFrame) -> DataFrame:
        """Adds where each visibility lies in cells, and the phase that moves the image's depths around zero."""
        turn = lambda c, p, n: F.least((F.col(c) * p - F.floor(F.col(c) * p)) * F.lit(float(n)), F.lit(math.nextafter(n, 0)))
        out = where.withColumns({"_x0": turn("u", self.pixsize[0], self.fine["iu"]), "_x1": turn("v", self.pixsize[1], self.fine["iv"])})
        whole = F.col("u") * self.center[0] + F.col("v") * self.center[1]
        if self.wgridding:
            out = out.withColumn("_x2", (F.col("w") - self.low) / self.step + self.kernel.width)
            whole = whole - F.col("w") * self.middle
        return out.withColumn("_angle", (whole - F.floor(whole)) * F.lit(2 * math.pi))

    @property
    def places(self) -> list[str]:
        return [f"_x{k}" for k in range(len(self.fine))]

    def screen(self, grid: DataFrame, sign: int) -> DataFrame:
        """Turns each plane by its w times the pixels' depths and divides by the kernel's transform along w."""
        x, y, nm1 = _sky(self.npix, self.pixsize, self.center, True)
        depth = nm1 - self.middle
        w = self.low + (F.col("ip") - self.kernel.width) * self.step
        turns = -w * depth * sign
        angle = (turns - F.floor(turns)) * F.lit(2 * math.pi)
        deep = computed(grid.withColumn("_depth", depth * self.step), ["_depth"], {"_f": "double"}, lambda d: 1 / self.kernel.transform(d))
        re, im = times((F.col("re"), F.col("im")), (F.cos(angle), F.sin(angle)))
        return deep.withColumns({"re": re * F.col("_f"), "im": im * F.col("_f")}).drop("_depth", "_f")


def vis2dirty_spread(baselines: DataFrame, channels: DataFrame, vis: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], epsilon: float = 1e-6, wgridding: bool = True, divide_by_n: bool = True, center: tuple[float, float] = (0.0, 0.0), sigma_min: float = 1.2, sigma_max: float = 2.5, **flips: bool) -> DataFrame:
    """As ``vis2dirty``, to a relative accuracy of ``epsilon``."""
    met = used(vis).join(wavelengths(baselines, channels, **flips), ["row", "chan"])
    stack = Stack.of(met, npix, pixsize, epsilon, wgridding, center, sigma_min, sigma_max)
    placed = stack.place(met)
    re, im = times((F.col("re"), F.col("im")), (F.cos("_angle"), F.sin("_angle")))
    grid = spread(placed.select(*stack.places, re.alias("re"), im.alias("im")), stack.places, stack.fine, stack.kernel)
    for axis, out, n in (("iu", "ix", npix[0]), ("iv", "iy", npix[1])):
        grid = corrected(line(grid, axis, stack.fine[axis], False), axis, n, stack.fine[axis], stack.kernel, False).withColumnRenamed(axis, out)
    if wgridding:
        grid = stack.screen(grid, 1)
    image = _whole(baselines.sparkSession, npix).join(grid.groupBy("ix", "iy").agg(F.sum("re").alias("value")), ["ix", "iy"], "left").fillna(0.0, ["value"])
    _, _, nm1 = _sky(npix, pixsize, center, wgridding)
    return image.withColumn("value", F.col("value") / (nm1 + 1)) if wgridding and divide_by_n else image


def _whole(spark, npix: tuple[int, int]) -> DataFrame:
    return spark.range(npix[0] * npix[1]).select(F.floor(F.col("id") / npix[1]).cast("long").alias("ix"), F.pmod("id", F.lit(npix[1])).cast("long").alias("iy"))


def dirty2vis_spread(baselines: DataFrame, channels: DataFrame, image: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], vis: DataFrame | None = None, epsilon: float = 1e-6, wgridding: bool = True, divide_by_n: bool = True, center: tuple[float, float] = (0.0, 0.0), sigma_min: float = 1.2, sigma_max: float = 2.5, **flips: bool) -> DataFrame:
    """As ``dirty2vis``, to a relative accuracy of ``epsilon``: the adjoint of ``vis2dirty_spread``, step by step."""
    where = wavelengths(baselines, channels, **flips)
    asked = where.withColumn("_g", F.lit(1.0)) if vis is None else where.join(_shares(vis), ["row", "chan"])
    stack = Stack.of(asked, npix, pixsize, epsilon, wgridding, center, sigma_min, sigma_max)
    _, _, nm1 = _sky(npix, pixsize, center, wgridding)
    value = F.col("value") / (nm1 + 1) if wgridding and divide_by_n else F.col("value")
    grid = image.select("ix", "iy", value.alias("re"), F.lit(0.0).alias("im"))
    if wgridding:
        grid = stack.screen(grid.withColumn("ip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stack.fine["ip"] - 1).cast("long")))), -1)
    for axis, given, n in (("iv", "iy", npix[1]), ("iu", "ix", npix[0])):
        grid = line(corrected(grid.withColumnRenamed(given, axis), axis, n, stack.fine[axis], stack.kernel, True), axis, stack.fine[axis], True)
    found = interpolate(grid, stack.fine, stack.place(asked), stack.places, stack.kernel, ["row", "chan", "_g", "_angle"])
    re, im = times((F.col("re"), F.col("im")), (F.cos("_angle"), -F.sin("_angle")))
    found = found.select("row", "chan", (re * F.col("_g")).alias("re"), (im * F.col("_g")).alias("im"))
    return where.select("row", "chan").join(found, ["row", "chan"], "left").fillna(0.0, ["re", "im"])


def ms2dirty(baselines: DataFrame, channels: DataFrame, ms: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], epsilon: float, do_wstacking: bool = False, **options) -> DataFrame:
    """``vis2dirty_spread`` by its older names; the image is divided by n only where w is taken into account."""
    return vis2dirty_spread(baselines, channels, ms, npix, pixsize, epsilon, do_wstacking, **options)


def dirty2ms(baselines: DataFrame, channels: DataFrame, dirty: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], epsilon: float, do_wstacking: bool = False, ms: DataFrame | None = None, **options) -> DataFrame:
    """``dirty2vis_spread`` by its older names."""
    return dirty2vis_spread(baselines, channels, dirty, npix, pixsize, ms, epsilon, do_wstacking, **options)


def facets(npix: tuple[int, int], pixsize: tuple[float, float], nx: int, ny: int, center: tuple[float, float] = (0.0, 0.0)) -> list[tuple[tuple[int, int], tuple[int, int], tuple[float, float]]]:
    """First pixel, size and centre of each tile of an image; sizes are even."""
    cuts = lambda n, k: [2 * (n // 2 * i // k) for i in range(k + 1)]
    out = []
    xs, ys = cuts(npix[0], nx), cuts(npix[1], ny)
    for a, b in zip(xs, xs[1:], strict=False):
        for c, d in zip(ys, ys[1:], strict=False):
            if a < b and c < d:
                out.append(((a, c), (b - a, d - c), (center[0] + ((a + b) / 2 - npix[0] / 2) * pixsize[0], center[1] + ((c + d) / 2 - npix[1] / 2) * pixsize[1])))
    return out


def vis2dirty_faceted(baselines: DataFrame, channels: DataFrame, vis: DataFrame, npix: tuple[int, int], pixsize: tuple[float, float], nx: int, ny: int, **options) -> DataFrame:
    """As ``vis2dirty``, tile by tile; the tiles are parts of one plan."""
    out = None
    for (ax, ay), size, center in facets(npix, pixsize, nx, ny, options.pop("center", (0.0, 0.0))):
        tile = vis2dirty(baselines, channels, vis, size, pixsize, center=center, **options)
        tile = tile.select((F.col("ix") + ax).alias("ix"), (F.col("iy") + ay).alias("iy"), "value")
        out = tile if out is None else out.unionByName(tile)
    return out


def w_histogram(baselines: DataFrame, channels: DataFrame, vis: DataFrame, bins: int = 50) -> DataFrame:
    """bin and n of the used visibilities by |w| in wavelengths, in equal bins up to the largest."""
    at = used(vis).select("row", "chan").join(wavelengths(baselines, channels), ["row", "chan"]).select(F.abs("w").alias("w"))
    top = at.agg(F.min("w").alias("low"), F.max("w").alias("high"))
    place = F.least(F.floor((F.col("w") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return at.crossJoin(top).groupBy(F.coalesce(place, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compact(vis: DataFrame) -> DataFrame:
    """row, chan: the weighted mean of both correlations (corr, re, im, wgt, flag); rows that are flagged throughout go."""
    good = vis.where(~F.col("flag"))
    w = F.sum("wgt")
    return good.groupBy("row", "chan").agg((F.sum(F.col("re") * F.col("wgt")) / w).alias("re"), (F.sum(F.col("im") * F.col("wgt")) / w).alias("im"), w.alias("wgt")).where("wgt > 0")
