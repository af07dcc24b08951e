"""Spreading of scattered values onto a periodic grid and interpolation from it, tile by tile, in one to three dimensions.

The grid is cut into tiles of about ``SIDES`` cells an axis. A point belongs to the tile of its footprint's first cell.
For spreading, points are range-partitioned by tile and a hash, so that a tile that holds any share of them is dealt out
over tasks; a task adds up each of its tiles in a dense array with a margin of the kernel's width, batch by batch, and
sends the touched cells on, which are summed by cell. So what is shuffled are the points once and the cells about once. For
interpolation, the tiles that hold points get their cells and the margin; a tile of more than ``MOST_POINTS`` points gets
several copies of them, one for each share of its points. Neither direction makes a row for a point and a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import ddl
from ..functions.kernels import Kernel

#: Cells along each axis of a tile, by the number of axes.
SIDES = {1: 8192, 2: 128, 3: 24}
#: Points of one tile that one group of the interpolation holds.
MOST_POINTS = 100_000
#: Kernel values that are worked on at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Tiles:
    """How a grid of ``sizes`` cells is cut; every axis wraps around."""

    sizes: tuple[int, ...]
    width: int

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(max(1, n // max(SIDES[len(self.sizes)], self.width)) for n in self.sizes)

    def start(self, axis: int, tile: int) -> int:
        return -(-tile * self.sizes[axis] // self.counts[axis])

    def first_cell(self, axis: int, at: Column) -> Column:
        return F.pmod(F.ceil(at - F.lit(self.width / 2)), F.lit(self.sizes[axis])).cast("long")

    def of_cell(self, axis: int, cell: Column) -> Column:
        return F.floor(cell * F.lit(self.counts[axis]) / F.lit(self.sizes[axis])).cast("long")

    def number(self, parts: Sequence[Column]) -> Column:
        out = F.lit(0).cast("long")
        for part, count in zip(parts, self.counts, strict=True):
            out = out * F.lit(count) + part
        return out

    def of_point(self, at: Sequence[str]) -> Column:
        return self.number([self.of_cell(k, self.first_cell(k, F.col(c))) for k, c in enumerate(at)])

    def corner(self, number: int) -> tuple[list[int], list[int]]:
        """First cell and extent, margin included, of a tile along each axis."""
        starts, extents = [], []
        for axis in range(len(self.sizes) - 1, -1, -1):
            number, tile = divmod(number, self.counts[axis])
            starts.append(self.start(axis, tile))
            extents.append(self.start(axis, tile + 1) - starts[-1] + self.width - 1)
        return starts[::-1], extents[::-1]

    def places(self, at: Sequence[np.ndarray], starts: Sequence[int], extents: Sequence[int], kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
        """For each point the numbers of its footprint's cells in the tile's array, and the kernel's values there."""
        place, weight = np.zeros((len(at[0]), 1), np.int64), np.ones((len(at[0]), 1))
        for axis, x in enumerate(at):
            first = np.ceil(x - self.width / 2)
            away = (first - x)[:, None] + np.arange(self.width)
            own = (first.astype(np.int64) % self.sizes[axis] - starts[axis])[:, None] + np.arange(self.width)
            place = (place[:, :, None] * extents[axis] + own[:, None, :]).reshape(len(x), -1)
            weight = (weight[:, :, None] * kernel.weights(away)[:, None, :]).reshape(len(x), -1)
        return place, weight


def _numbers(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]


def spread(points: DataFrame, at: Sequence[str], sizes: Mapping[str, int], kernel: Kernel, values: Sequence[str] = ("re", "im")) -> DataFrame:
    """The sums of the points' values times the kernel by cell: the axes of ``sizes`` and ``values``; untouched cells have no row.

    ``at`` names the points' places in cells, each within its axis.
    """
    tiles, axes = Tiles(tuple(sizes.values()), kernel.width), list(sizes)
    step = max(1, STEP // kernel.width ** len(axes))

    def touched(number: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        starts, extents = tiles.corner(number)
        held = np.flatnonzero(np.any([s != 0 for s in sums], axis=0))
        cells, rest = [], held
        for axis in range(len(axes) - 1, -1, -1):
            rest, own = np.divmod(rest, extents[axis])
            cells.append((own + starts[axis]) % tiles.sizes[axis])
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in cells[::-1]], *[pa.array(s[held]) for s in sums]], names=[*axes, *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, starts, extents = None, [], [], []
        for batch in batches:
            tile, *rest = _numbers(batch, ["_tile", *at, *values])
            places, given = rest[: len(at)], rest[len(at) :]
            cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if tile[a] != now:
                    if now is not None:
                        yield touched(now, sums)
                    now = int(tile[a])
                    starts, extents = tiles.corner(now)
                    sums = [np.zeros(int(np.prod(extents))) for _ in values]
                for low in range(a, b, step):
                    high = min(b, low + step)
                    place, weight = tiles.places([x[low:high] for x in places], starts, extents, kernel)
                    flat = place.ravel()
                    for total, v in zip(sums, given, strict=True):
                        total += np.bincount(flat, (weight * v[low:high, None]).ravel(), len(total))
        if now is not None:
            yield touched(now, sums)

    located = points.select(tiles.of_point(at).alias("_tile"), *[F.col(c).cast("double").alias(c) for c in (*at, *values)])
    dealt = located.repartitionByRange("_tile", F.xxhash64(*at, *values)).sortWithinPartitions("_tile")
    schema = ", ".join([*[f"`{a}` bigint" for a in axes], *[f"`{v}` double" for v in values]])
    return dealt.mapInArrow(run, schema).groupBy(*axes).agg(*[F.sum(v).alias(v) for v in values])


def interpolate(grid: DataFrame, sizes: Mapping[str, int], points: DataFrame, at: Sequence[str], kernel: Kernel, keep: Sequence[str], values: Sequence[str] = ("re", "im")) -> DataFrame:
    """The points' columns ``keep`` with the sums of the cells' values times the kernel; cells without a row are zero.

    Only tiles that hold points get their cells.
    """
    tiles, axes = Tiles(tuple(sizes.values()), kernel.width), list(sizes)
    step = max(1, STEP // kernel.width ** len(axes))
    named = {f"_v{k}": v for k, v in enumerate(values)}
    located = points.select(*[F.col(f"`{c}`") for c in keep], *[F.col(c).cast("double").alias(f"_at{k}") for k, c in enumerate(at)], tiles.of_point(at).alias("_tile"))
    places = [f"_at{k}" for k in range(len(at))]
    counted = located.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / MOST_POINTS).cast("int").alias("_parts"))
    dealt = located.join(counted.where("_parts > 1"), "_tile", "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keep]), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")

    cells = grid.select(*axes, *[F.col(v).alias(k) for k, v in named.items()])
    for k, axis in enumerate(axes):
        owners = F.array_distinct(F.array(tiles.of_cell(k, F.col(axis)), tiles.of_cell(k, F.pmod(F.col(axis) - (kernel.width - 1), F.lit(tiles.sizes[k])))))
        cells = cells.withColumn(f"_t{k}", F.explode(owners))
    cells = cells.withColumn("_tile", tiles.number([F.col(f"_t{k}") for k in range(len(axes))])).drop(*[f"_t{k}" for k in range(len(axes))])
    cells = cells.join(counted, "_tile").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        out = [np.zeros(own.num_rows) for _ in values]
        if own.num_rows and given.num_rows:
            starts, extents = tiles.corner(own.column("_tile")[0].as_py())
            where = [((c - s) % n) for c, s, n in zip(_numbers(given, axes), starts, tiles.sizes, strict=True)]
            held = [np.zeros(int(np.prod(extents))) for _ in values]
            for again in product((0, 1), repeat=len(axes)):  # on an axis of one tile the first cells stand again behind the last
                moved = [w + n * g for w, n, g in zip(where, tiles.sizes, again, strict=True)]
                inside = np.all([m < e for m, e in zip(moved, extents, strict=True)], axis=0)
                flat = np.zeros(int(inside.sum()), np.int64)
                for m, e in zip(moved, extents, strict=True):
                    flat = flat * e + m[inside]
                for total, v in zip(held, _numbers(given, list(named)), strict=True):
                    total += np.bincount(flat, v[inside], len(total))
            spots = _numbers(own, places)
            for low in range(0, own.num_rows, step):
                place, weight = tiles.places([x[low : low + step] for x in spots], starts, extents, kernel)
                for total, cells_ in zip(out, held, strict=True):
                    total[low : low + step] = (weight * cells_[place]).sum(axis=1)
        return pa.table([*[own.column(c) for c in keep], *[pa.array(x) for x in out]], names=[*keep, *values])

    schema = ", ".join([ddl(points.select(*[F.col(f"`{c}`") for c in keep])), *[f"`{v}` double" for v in values]])
    return dealt.groupBy("_tile", "_part").cogroup(cells.groupBy("_tile", "_part")).applyInArrow(run, schema)
