"""The smallest circle on the sphere that encloses points, and the turn of three points."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cap(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and cosine of the radius of the smallest cap that holds a few unit vectors, by all that two or three of them bound."""
    if len(points) == 1:
        return points[0], 1.0
    found = []
    for k in (2, 3):
        for some in combinations(range(len(points)), k):
            p = points[list(some)]
            c = p.sum(axis=0) if k == 2 else np.cross(p[1] - p[0], p[2] - p[0])
            size = np.linalg.norm(c)
            if size > 1e-12:
                found += [(c / size, float((points @ c).min() / size)), (-c / size, float((points @ -c).min() / size))]
    if not found:
        raise ValueError("opposite points have no smallest circle")
    return max(found, key=lambda f: f[1])


def enclosing_circle(points: DataFrame) -> tuple[float, float, float]:
    """theta, phi and radius of the smallest circle around all rows (x, y, z) of unit vectors.

    A few points that bound the circle are held; each pass finds the row that lies farthest outside, by an aggregate
    that is combined before the shuffle, until none does. A pass brings one row to the driver, and the circle grows with
    each, so that passes are few.
    """
    columns = ("x", "y", "z")
    first = points.select(*columns).first()
    if first is None:
        raise ValueError("no points")
    held = np.array([tuple(first)], float)
    while True:
        center, cosine = _cap(held)
        dot = sum((F.col(c) * float(v) for c, v in zip(columns, center, strict=True)), F.lit(0.0))
        row = points.select(F.min(F.struct(dot.alias("d"), *columns))).first()[0]
        far = np.array([row.x, row.y, row.z])
        if row.d >= cosine - 1e-14 or (np.abs(held - far).max(axis=1) == 0).any():
            break
        # of the points held only those on the circle can bound a larger one together with the new point
        on = np.abs(held @ center - cosine) < 1e-9
        held = np.vstack([held[on], far])
    radius = math.atan2(np.linalg.norm(np.cross(center, held[np.argmin(held @ center)])), float((held @ center).min()))
    return math.atan2(math.hypot(center[0], center[1]), center[2]), math.atan2(center[1], center[0]) % (2 * math.pi), radius


def cosdist_zphi(z1: Column, phi1: Column, z2: Column, phi2: Column) -> Column:
    """The cosine of the distance of two directions given by z and phi."""
    return z1 * z2 + F.cos(phi1 - phi2) * F.sqrt((1 - z1 * z1) * (1 - z2 * z2))


def orientation(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], c: tuple[Column, Column, Column]) -> Column:
    """The triple product of three vectors: positive if they turn to the left, seen from outside."""
    return (a[1] * b[2] - a[2] * b[1]) * c[0] + (a[2] * b[0] - a[0] * b[2]) * c[1] + (a[0] * b[1] - a[1] * b[0]) * c[2]
