"""Complex numbers as pairs of double columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(re: str = "re", im: str = "im") -> Pair:
    return F.col(re), F.col(im)


def times(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def cis(angle: Column) -> Pair:
    """exp(i * angle)."""
    return F.cos(angle), F.sin(angle)


def root(power: Column, n: int, sign: int = -1) -> Pair:
    """exp(sign * 2 pi i * power / n) for integer powers, which are reduced exactly before they become angles."""
    return cis(F.pmod(power, F.lit(n)) * F.lit(sign * 2 * math.pi / n))
