"""Least squares by bidiagonalisation (Fong and Saunders 2011), for operators that are given as plans over tables.

A step takes one transform each way and writes two tables; the earlier ones go. Only squared lengths reach the driver.
The equations themselves are worked on, not the normal ones, so the condition number does not enter squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import harmonic as H
from . import interpolated as I
from .staging import Steps

KEYS = ("comp", "l", "m")


class Solution(NamedTuple):
    """Coefficients, why it stopped (1: the equations hold, 2: a least-squares solution, 3: the condition number is too
    large, 7: all steps taken), steps, the residual over the data, and the gradient over operator times residual."""

    alm: DataFrame
    istop: int
    iterations: int
    residual: float
    quality: float


def _length(df: DataFrame, *pairs: tuple[str, str]) -> list[float]:
    """Lengths of coefficients of real maps, in which each m > 0 stands for two."""
    twice = F.when(F.col("m") == 0, 1.0).otherwise(2.0)
    row = df.agg(*[F.sum(twice * (F.col(a) * F.col(a) + F.col(b) * F.col(b))) for a, b in pairs]).first()
    return [math.sqrt(v or 0.0) for v in row]


def lsmr(data: DataFrame, forward: Callable[[DataFrame], DataFrame], adjoint: Callable[[DataFrame], DataFrame], cells: Sequence[str], maxiter: int = 20, atol: float = 1e-6, btol: float = 1e-6, conlim: float = 1e8) -> Solution:
    """The coefficients (comp, l, m, re, im) whose image comes nearest to ``data`` (cells, value).

    ``adjoint`` is that of ``forward`` for lengths in which each m > 0 counts twice. Cells that an image lacks are zero.
    """
    steps = Steps(data.sparkSession, "lsmr")
    u = steps.put(data.select(*cells, "value"))
    beta = norm_b = math.sqrt(u.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
    scaled = lambda df, f: df.select(*cells, (F.col("value") * f).alias("value"))
    first = adjoint(scaled(u, 1 / beta if beta else 0.0)).select(*KEYS, F.col("re").alias("gre"), F.col("im").alias("gim"))
    state = steps.put(first.select(*KEYS, *[F.lit(0.0).alias(c) for c in ("xre", "xim", "bre", "bim")], F.col("gre").alias("hre"), F.col("gim").alias("him"), "gre", "gim"))
    (alpha,) = _length(state, ("gre", "gim"))
    norm_ar = alpha * beta
    answer = lambda df: df.select(*KEYS, F.col("xre").alias("re"), F.col("xim").alias("im"))
    if not norm_ar:
        return Solution(answer(state), 1 if not beta else 2, 0, 1.0 if beta else 0.0, 0.0)
    # v is g / alpha; h starts as v
    state = state.withColumns({"hre": F.col("hre") / alpha, "him": F.col("him") / alpha})
    alpha_bar, zeta_bar, rho, rho_bar, c_bar, s_bar = alpha, alpha * beta, 1.0, 1.0, 1.0, 0.0
    beta_dd, beta_d, rho_d, tau_old, theta_t, zeta = beta, 0.0, 1.0, 0.0, 0.0, 0.0
    norm_a2, largest, least = alpha * alpha, 0.0, math.inf
    istop, done, norm_r, quality = 7, 0, beta, 1.0
    while done < maxiter:
        done += 1
        v = state.select(*KEYS, (F.col("gre") / alpha).alias("re"), (F.col("gim") / alpha).alias("im"))
        image = forward(v).select(*cells, "value")
        u = steps.put(image.unionByName(scaled(u, -alpha / beta if beta else 0.0)).groupBy(*cells).agg(F.sum("value").alias("value")))
        beta = math.sqrt(u.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0)
        back = adjoint(scaled(u, 1 / beta if beta else 0.0)).select(*KEYS, F.col("re").alias("nre"), F.col("im").alias("nim"))
        met = state.join(back, list(KEYS), "left").fillna(0.0, ["nre", "nim"])
        new = {f"n{p}": F.col(f"n{p}") - F.col(f"g{p}") * (beta / alpha) for p in ("re", "im")}
        wide = steps.put(met.withColumns(new))
        (alpha,) = _length(wide, ("nre", "nim"))
        steps.keep_only(u, wide)
        # rotations
        rho_old, rho = rho, math.hypot(alpha_bar, beta)
        c, s = alpha_bar / rho, beta / rho
        theta, alpha_bar = s * alpha, c * alpha
        rho_bar_old, zeta_old = rho_bar, zeta
        theta_bar, rho_temp = s_bar * rho, c_bar * rho
        rho_bar = math.hypot(rho_temp, theta)
        c_bar, s_bar = rho_temp / rho_bar, theta / rho_bar
        zeta, zeta_bar = c_bar * zeta_bar, -s_bar * zeta_bar
        # h-bar, x, h, and v as g / alpha
        f_bar, f_x, f_h = theta_bar * rho / (rho_old * rho_bar_old), zeta / (rho * rho_bar), theta / rho
        out: dict[str, Column] = {}
        for p in ("re", "im"):
            bar = F.col(f"h{p}") - F.col(f"b{p}") * f_bar
            out |= {f"x{p}": F.col(f"x{p}") + bar * f_x, f"b{p}": bar, f"h{p}": F.col(f"n{p}") * (1 / alpha if alpha else 0.0) - F.col(f"h{p}") * f_h, f"g{p}": F.col(f"n{p}")}
        state = wide.select(*KEYS, *[e.alias(c_) for c_, e in out.items()])
        # the residual's length, from the same rotations
        beta_hat, beta_dd = c * beta_dd, -s * beta_dd
        theta_t_old, rho_t = theta_t, math.hypot(rho_d, theta_bar)
        c_t, s_t = rho_d / rho_t, theta_bar / rho_t
        theta_t, rho_d = s_t * rho_bar, c_t * rho_bar
        beta_d = -s_t * beta_d + c_t * beta_hat
        tau_old = (zeta_old - theta_t_old * tau_old) / rho_t
        tau_d = (zeta - theta_t * tau_old) / rho_d
        norm_r = math.hypot(beta_d - tau_d, beta_dd)
        # sizes, and whether to stop
        norm_a2 += beta * beta
        norm_a = math.sqrt(norm_a2)
        norm_a2 += alpha * alpha
        largest = max(largest, rho_bar_old) if done > 1 else largest
        least = min(least, rho_bar_old) if done > 1 else least
        condition = max(largest, rho_temp) / max(min(least, rho_temp), 1e-300)
        norm_ar = abs(zeta_bar)
        (norm_x,) = _length(state, ("xre", "xim"))
        quality = norm_ar / (norm_a * norm_r) if norm_a * norm_r else 0.0
        if norm_r <= norm_b * btol + atol * norm_a * norm_x:
            istop = 1
        elif quality <= atol or not alpha:
            istop = 2
        elif condition >= conlim:
            istop = 3
        if istop != 7:
            break
    x = steps.put(answer(state))
    steps.keep_only(x)
    return Solution(x, istop, done, norm_r / norm_b, quality)


def pseudo_analysis(pixels: DataFrame, rings: DataFrame, lmax: int, mmax: int, spin: int = 0, maxiter: int = 20, epsilon: float = 1e-6, conlim: float = 1e8) -> Solution:
    """Least-squares coefficients of a map (comp, ring, ipix, value) on any rings."""
    held = pixels if "comp" in pixels.columns else pixels.withColumn("comp", F.lit(0).cast("long"))
    return lsmr(held, lambda a: H.synthesis(a, rings, lmax, mmax, spin), lambda p: H.adjoint_synthesis(p, rings, lmax, mmax, spin), ("comp", "ring", "ipix"), maxiter, epsilon, epsilon, conlim)


def pseudo_analysis_general(points: DataFrame, lmax: int, mmax: int, spin: int = 0, key: str = "id", maxiter: int = 20, epsilon: float = 1e-6, conlim: float = 1e8) -> Solution:
    """The same for values at any directions (key, theta, phi, value and, with spin, comp), by transforms ten times as accurate."""
    held = points if "comp" in points.columns else points.withColumn("comp", F.lit(0).cast("long"))
    places = held.select(key, "theta", "phi").distinct()
    inner = max(0.1 * epsilon, 1e-11)
    forward = lambda a: I.synthesis_general(a, places, lmax, mmax, spin, key, inner)
    adjoint = lambda p: I.adjoint_synthesis_general(p.join(places.hint("merge"), key), lmax, mmax, spin, inner)
    return lsmr(held, forward, adjoint, ("comp", key), maxiter, epsilon, epsilon, conlim)
