"""Equal-area pixels of the sphere over tables: coordinates, neighbours, regions and maps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix as H
from ..functions.batches import computed
from .ranges import normalise


def pix2ang(df: DataFrame, nside: int, scheme: str = "RING", pix: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, [pix], {"theta": "double", "phi": "double"}, lambda p: H.pix2ang(nside, p, scheme))


def ang2pix(df: DataFrame, nside: int, scheme: str = "RING", out: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, ["theta", "phi"], {out: "bigint"}, lambda t, p: H.ang2pix(nside, t, p, scheme))


def pix2vec(df: DataFrame, nside: int, scheme: str = "RING", pix: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, [pix], {"x": "double", "y": "double", "z": "double"}, lambda p: H.pix2vec(nside, p, scheme))


def vec2pix(df: DataFrame, nside: int, scheme: str = "RING", out: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, ["x", "y", "z"], {out: "bigint"}, lambda x, y, z: H.vec2pix(nside, x, y, z, scheme))


def pix2xyf(df: DataFrame, nside: int, scheme: str = "RING", pix: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, [pix], {"ix": "bigint", "iy": "bigint", "face": "bigint"}, lambda p: H.pix2xyf(nside, p, scheme))


def xyf2pix(df: DataFrame, nside: int, scheme: str = "RING", out: str = "pix") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, ["ix", "iy", "face"], {out: "bigint"}, lambda x, y, f: H.xyf2pix(nside, x, y, f, scheme))


def ring2nest(df: DataFrame, nside: int, pix: str = "pix", out: str = "nest") -> DataFrame:
    H.checked(nside, "NEST")
    return computed(df, [pix], {out: "bigint"}, lambda p: H.ring2nest(nside, p))


def nest2ring(df: DataFrame, nside: int, pix: str = "nest", out: str = "pix") -> DataFrame:
    H.checked(nside, "NEST")
    return computed(df, [pix], {out: "bigint"}, lambda p: H.nest2ring(nside, p))


def pix2ring(df: DataFrame, nside: int, scheme: str = "RING", pix: str = "pix", out: str = "ring") -> DataFrame:
    H.checked(nside, scheme)
    return computed(df, [pix], {out: "bigint"}, lambda p: H.ring_of(nside, p if scheme == "RING" else H.nest2ring(nside, p)))


def neighbors(df: DataFrame, nside: int, scheme: str = "RING", pix: str = "pix") -> DataFrame:
    """One row per pixel and direction (0 SW, 1 W, ... 7 S) that has a neighbour."""
    H.checked(nside, scheme)
    listed = computed(df, [pix], {"_near": "array<bigint>"}, lambda p: H.neighbors(nside, p, scheme))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return listed.select(*kept, F.posexplode("_near").alias("direction", "neighbor")).where("neighbor >= 0")


def boundaries(df: DataFrame, nside: int, step: int = 1, scheme: str = "RING", pix: str = "pix") -> DataFrame:
    """4 * step points along the border of each pixel, from its north corner over west, south and east."""
    H.checked(nside, scheme)
    listed = computed(df, [pix], {"_z": "array<double>", "_phi": "array<double>"}, lambda p: H.boundaries(nside, p, step, scheme))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return listed.select(*kept, F.posexplode(F.arrays_zip("_z", "_phi")).alias("point", "_at")).select(*kept, "point", F.col("_at._z").alias("z"), F.col("_at._phi").alias("phi"))


def interpolation(df: DataFrame, nside: int) -> DataFrame:
    """The four RING pixels around each direction and their weights, a row for each."""
    listed = computed(df, ["theta", "phi"], {"_pix": "array<bigint>", "_weight": "array<double>"}, lambda t, p: H.interpolation(nside, t, p))
    kept = [F.col(f"`{c}`") for c in df.columns]
    return listed.select(*kept, F.explode(F.arrays_zip("_pix", "_weight")).alias("_at")).select(*kept, F.col("_at._pix").alias("pix"), F.col("_at._weight").alias("weight"))


def interpolate(points: DataFrame, pixels: DataFrame, nside: int, key: str = "id") -> DataFrame:
    """key and value of each direction: the weighted mean of the pixels that the map (pix, value) holds; null where it holds none."""
    around = interpolation(points.select(key, "theta", "phi"), nside)
    held = around.join(pixels.select("pix", "value"), "pix", "left")
    known = F.when(F.col("value").isNotNull(), F.col("weight"))
    return held.groupBy(key).agg((F.sum(known * F.col("value")) / F.nullif(F.sum(known), F.lit(0.0))).alias("value"))


def rings(spark: SparkSession, nside: int) -> DataFrame:
    """ring (from 1), theta, nphi, phi0 and ringstart of every ring, for harmonic transforms."""
    H.checked(nside, "RING")
    table = spark.range(1, 4 * nside).withColumnRenamed("id", "ring")
    return computed(table, ["ring"], {"theta": "double", "nphi": "bigint", "phi0": "double", "ringstart": "bigint"}, lambda r: H.ring_info(nside, r))


def _arc(nside: int, ring: np.ndarray, phi: float, half: np.ndarray) -> np.ndarray:
    """Pixel ranges of rings whose centres lie within ``half`` of longitude ``phi``; an arc over longitude 0 is two."""
    _, count, first, start = H.ring_info(nside, ring)
    step = 2 * math.pi / count
    low, high = np.ceil((phi - half - first) / step - 1e-12).astype(np.int64), np.floor((phi + half - first) / step + 1e-12).astype(np.int64)
    whole = (high - low + 1 >= count) | (half >= math.pi)
    some = (half >= 0) & (high >= low) | whole
    a, n = np.where(whole, 0, low % count), np.where(whole, count, high - low + 1)
    straight = np.stack([start + a, start + np.minimum(a + n, count)], axis=1)[some]
    over = some & (a + n > count)
    return np.concatenate([straight, np.stack([start, start + a + n - count], axis=1)[over]])


def _half_widths(nside: int, ring: np.ndarray, theta: float, radius: float) -> np.ndarray:
    """Half the longitudes of each ring that a disc covers; negative where it covers none."""
    t = H.ring_theta(nside, ring)
    out = np.full(len(ring), -1.0)
    near = np.abs(t - theta) <= radius
    # haversines keep small discs precise
    have = np.sin(radius / 2) ** 2 - np.sin((t - theta) / 2) ** 2
    scale = np.sin(t) * math.sin(theta)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[near] = np.where(scale[near] <= 0, math.pi, 2 * np.arcsin(np.sqrt(np.clip(have[near] / scale[near], 0, 1))))
    return out if radius < math.pi else np.full(len(ring), math.pi)


def query_disc(discs: DataFrame, nside: int, scheme: str = "RING", key: str = "id") -> DataFrame:
    """key, lo, hi: ranges of the pixels whose centres lie within ``radius`` of (theta, phi)."""
    H.checked(nside, scheme)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, theta, phi, radius in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = max(1, int(H.ring_above(nside, np.array([math.cos(max(0.0, theta - radius))]))[0]))
                high = min(4 * nside - 1, int(H.ring_above(nside, np.array([math.cos(min(math.pi, theta + radius))]))[0]) + 1)
                for at in range(low, high + 1, 1 << 16):
                    ring = np.arange(at, min(high + 1, at + (1 << 16)))
                    found = _arc(nside, ring, phi, _half_widths(nside, ring, theta, radius))
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(found), pa.int64()), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["key", "lo", "hi"])

    picked = discs.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("theta", "phi", "radius")]).dropna()
    if scheme == "NEST":
        sine = F.sin("theta")
        cap = F.struct((sine * F.cos("phi")).alias("x"), (sine * F.sin("phi")).alias("y"), F.cos("theta").alias("z"), "radius")
        ranges = descended(picked.select("key", F.array(cap).alias("caps")), nside)
    else:
        ranges = picked.mapInArrow(run, "key long, lo long, hi long")
    return normalise(ranges.withColumnRenamed("key", key), [key])


#: Depth at which the cells of regions are dealt out over tasks, and cells that a task looks at together.
DEAL_ORDER, CELLS = 3, 1 << 15


def _within(nside: int, pixels: np.ndarray, caps: np.ndarray, slack: float) -> np.ndarray:
    """Whether NEST pixels' centres lie in all caps (x, y, z, radius), each made wider by ``slack``."""
    v = np.stack(H.pix2vec(nside, pixels, "NEST"), axis=1)
    out = np.ones(len(pixels), bool)
    for c in caps:
        angle = np.arctan2(np.linalg.norm(np.cross(v, c[:3]), axis=1), v @ c[:3])
        out &= angle <= c[3] + slack
    return out


def _cells_within(order: int, depth: int, cell: int, caps: np.ndarray) -> Iterator[np.ndarray]:
    """Ranges of a cell's NEST pixels in all caps: a cell that is whole in or out is not looked into."""
    stack = [(depth, np.array([cell], np.int64))]
    while stack:
        d, cells = stack.pop()
        if d == order:
            found = cells[_within(1 << d, cells, caps, 1e-13)]
            yield np.stack([found, found + 1], axis=1)
            continue
        reach = H.max_pixrad(1 << d)
        some = cells[_within(1 << d, cells, caps, reach)]
        whole = _within(1 << d, some, caps, -reach)
        shift = 2 * (order - d)
        yield np.stack([some[whole] << shift, (some[whole] + 1) << shift], axis=1)
        children = (some[~whole][:, None] * 4 + np.arange(4)).ravel()
        stack += [(d + 1, children[k : k + CELLS]) for k in range(0, len(children), CELLS)]


def descended(regions: DataFrame, nside: int) -> DataFrame:
    """key, lo, hi: NEST ranges of the pixels whose centres lie in all of a region's caps (key, caps), by the hierarchy of cells.

    Regions are dealt out by cells of a coarse map; within these, only cells that a border crosses are divided.
    """
    order = H.order(nside)
    depth = min(order, DEAL_ORDER)
    dealt = regions.select("key", "caps", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(H.npix(1 << depth) - 1).cast("long"))).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, caps, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = np.array([[c[n] for n in ("x", "y", "z", "radius")] for c in caps])
                for found in _cells_within(order, depth, cell, held):
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["key", "lo", "hi"])

    return dealt.repartition("key", "cell").mapInArrow(run, "key long, lo long, hi long")


def query_disc_inclusive(discs: DataFrame, nside: int, scheme: str = "RING", key: str = "id") -> DataFrame:
    """All pixels that overlap the disc, and perhaps a few that nearly do: centres within the radius and a pixel's own."""
    return query_disc(discs.withColumn("radius", F.least(F.col("radius") + F.lit(H.max_pixrad(nside)), F.lit(math.pi))), nside, scheme, key)


def query_strip(spark: SparkSession, nside: int, theta1: float, theta2: float, inclusive: bool = False) -> DataFrame:
    """RING ranges between two colatitudes; if the first is larger, those outside them.

    ``inclusive`` adds the rings whose pixels reach into the strip.
    """
    strips = [(theta1, theta2)] if theta1 < theta2 else [(0.0, theta2), (theta1, math.pi)]
    reach = H.max_pixrad(nside) if inclusive else 0.0
    inside = F.lit(False)
    for low, high in strips:
        inside = inside | F.col("theta").between(low - reach, high + reach)
    found = rings(spark, nside).where(inside).select(F.col("ringstart").alias("lo"), (F.col("ringstart") + F.col("nphi")).alias("hi"))
    return normalise(found)


def query_polygon(spark: SparkSession, nside: int, corners: list[tuple[float, float]], inclusive: bool = False, scheme: str = "RING") -> DataFrame:
    """Ranges of the pixels whose centres lie within a convex polygon of (theta, phi) corners.

    The polygon is where the hemispheres behind all its sides meet: on each ring the places that all of their arcs cover,
    or by descent through cells for NEST. ``inclusive`` adds all that overlap it, and perhaps a few that nearly do.
    """
    H.checked(nside, scheme)
    points = np.array([H.ang2vec(t, p) for t, p in corners])
    sides = np.cross(points, np.roll(points, -1, axis=0))
    sides /= np.linalg.norm(sides, axis=1)[:, None]
    turn = np.einsum("ij,ij->i", sides, np.roll(points, -2, axis=0))
    if len(corners) < 3 or (np.abs(turn) < 1e-10).any() or not (np.sign(turn) == np.sign(turn[0])).all():
        raise ValueError("the polygon is not convex or has a corner of no turn")
    sides *= np.sign(turn[0])
    radius = math.pi / 2 + (H.max_pixrad(nside) if inclusive else 0.0)
    if scheme == "NEST":
        caps = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xyz", side, strict=True)], F.lit(radius).alias("radius")) for side in sides])
        return normalise(descended(spark.range(1).select(F.col("id").alias("key"), caps.alias("caps")), nside).drop("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = list(zip(*H.vec2ang(*sides.T), strict=True))
        for batch in batches:
            ring = batch.column(0).to_numpy()
            for low in range(0, len(ring), 4096):
                some = ring[low : low + 4096]
                arcs = np.concatenate([_arc(nside, some, phi, _half_widths(nside, some, theta, radius)) for theta, phi in centers])
                at = np.concatenate([arcs[:, 0], arcs[:, 1]])
                order = np.argsort(at, kind="stable")
                cover, at = np.cumsum(np.repeat([1, -1], len(arcs))[order]), at[order]
                inside = np.flatnonzero((cover == len(centers)) & (at < np.r_[at[1:], 0]))
                yield pa.RecordBatch.from_arrays([pa.array(at[inside]), pa.array(at[inside + 1])], names=["lo", "hi"])

    return normalise(spark.range(1, 4 * nside).mapInArrow(run, "lo long, hi long"))


def _other_order(df: DataFrame, nside: int, scheme: str, pix: str) -> DataFrame:
    return ring2nest(df, nside, pix, "_nest") if scheme == "RING" else df.withColumn("_nest", F.col(pix))


def degrade(pixels: DataFrame, nside: int, to: int, scheme: str = "RING", least: int = 1) -> DataFrame:
    """pix, value and n of a coarser map: the mean of the known pixels, null where fewer than ``least`` are known."""
    if to > nside or nside % to:
        raise ValueError("the coarser map's nside must divide the finer one's")
    ratio = (nside // to) ** 2
    parents = _other_order(pixels.select("pix", "value"), nside, scheme, "pix").withColumn("_nest", F.floor(F.col("_nest") / ratio))
    n = F.count("value")
    found = parents.groupBy("_nest").agg(F.when(n >= least, F.avg("value")).alias("value"), n.alias("n"))
    if scheme == "RING":
        return nest2ring(found, to, "_nest", "pix").select("pix", "value", "n")
    return found.select(F.col("_nest").alias("pix"), "value", "n")


def upgrade(pixels: DataFrame, nside: int, to: int, scheme: str = "RING") -> DataFrame:
    """pix and value of a finer map: each pixel takes its parent's value."""
    if to < nside or to % nside:
        raise ValueError("the finer map's nside must be a multiple of the coarser one's")
    ratio = (to // nside) ** 2
    children = _other_order(pixels.select("pix", "value"), nside, scheme, "pix")
    found = children.select("value", F.explode(F.sequence(F.col("_nest") * ratio, F.col("_nest") * ratio + (ratio - 1))).alias("_nest"))
    if scheme == "RING":
        return nest2ring(found, to, "_nest", "pix").select("pix", "value")
    return found.select(F.col("_nest").alias("pix"), "value")


def statistics(pixels: DataFrame) -> DataFrame:
    """Known pixels, mean, rms about the mean, least, largest and largest absolute value of a map; null is unknown."""
    v = F.col("value")
    return pixels.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"), F.min(v).alias("low"), F.max(v).alias("high"), F.max(F.abs(v)).alias("top"))


def median_within(points: DataFrame, pixels: DataFrame, nside: int, key: str = "id") -> DataFrame:
    """The median of the known RING pixels within ``radius`` of each direction."""
    at = query_disc(points, nside, "RING", key).select(key, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pix"))
    return at.join(pixels.select("pix", "value"), "pix").groupBy(key).agg(F.expr("percentile(value, 0.5)").alias("value"), F.count("value").alias("n"))


def ang2vec(df: DataFrame) -> DataFrame:
    """Adds the unit vector x, y, z of (theta, phi)."""
    s = F.sin("theta")
    return df.withColumns({"x": s * F.cos("phi"), "y": s * F.sin("phi"), "z": F.cos("theta")})


def vec2ang(df: DataFrame) -> DataFrame:
    """Adds theta and phi, from 0 to 2 pi, of the vector (x, y, z) of any length."""
    phi = F.atan2("y", "x")
    return df.withColumns({"theta": F.atan2(F.hypot("x", "y"), F.col("z")), "phi": F.when(phi < 0, phi + 2 * math.pi).otherwise(phi)})


def v_angle(df: DataFrame, a: Sequence[str], b: Sequence[str], out: str = "angle") -> DataFrame:
    """Adds the angle between two vectors, each named by three columns, also where it is tiny or nearly pi."""
    (ax, ay, az), (bx, by, bz) = ([F.col(c) for c in v] for v in (a, b))
    cross = F.hypot(F.hypot(ay * bz - az * by, az * bx - ax * bz), ax * by - ay * bx)
    return df.withColumn(out, F.atan2(cross, ax * bx + ay * by + az * bz))
