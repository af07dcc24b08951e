"""The spreading kernel, its Fourier transform, and a table of measured errors from which widths are chosen.

The kernel is the published exponential of a semicircle (Barnett et al. 2019). Its error is not taken from a formula
but measured: waves up to the highest that a grid of a given oversampling carries are put together from the kernel's
samples at many places within a cell, and the worst deviation counts. For each width and oversampling the exponent that
makes it least is searched for.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

WIDTHS = range(2, 17)
SIGMAS = (1.25, 1.5, 1.75, 2.0, 2.25, 2.5)
#: Places within a cell, and waves, at which errors are measured.
PLACES, WAVES = 8, 24
#: The error of a sum of many waves may pass that of the worst one by rounding and by places between those measured.
MARGIN = 1.5


@dataclass(frozen=True)
class Kernel:
    """exp(beta (sqrt(1 - x**2) - 1)) on ``width`` cells, for grids ``sigma`` times as fine as their modes need."""

    width: int
    beta: float
    sigma: float = 2.0

    def weights(self, distance: np.ndarray) -> np.ndarray:
        """Values at distances in cells."""
        x = distance * (2.0 / self.width)
        return np.exp(self.beta * (np.sqrt(np.maximum(0.0, 1 - x * x)) - 1))

    def transform(self, frequency: np.ndarray) -> np.ndarray:
        """The Fourier transform at frequencies in cycles a cell, by Gauss-Legendre quadrature."""
        x, w = _nodes(self.width)
        values = np.exp(self.beta * (np.sqrt(1 - x * x) - 1)) * w
        return self.width / 2 * np.cos(np.pi * self.width * np.outer(frequency, x)) @ values

    def error(self) -> float:
        """The worst deviation of a wave put together from samples of the kernel, corrected by its transform."""
        f = 0.5 / self.sigma * np.r_[0, 0.3, 0.6, np.linspace(0.75, 1, WAVES)]  # the error has narrow dips, so high waves are sampled densely
        near = np.geomspace(1e-7, 0.1, 8)  # the footprint moves on at whole or half cells, and the kernel falls steeply at its ends
        at = np.r_[(np.arange(PLACES) + 0.25) / PLACES, near, 1 - near, 0.5 - near, 0.5 + near]
        cells = np.ceil(at - self.width / 2)[:, None] + np.arange(self.width)
        away = cells - at[:, None]
        waves = np.einsum("pw,pwf->pf", self.weights(away), np.exp(2j * np.pi * away[:, :, None] * f)) / self.transform(f)
        return float(np.abs(waves - 1).max())


@functools.lru_cache(maxsize=64)
def _nodes(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(4 * width + 40)


@functools.lru_cache(maxsize=256)
def best_kernel(width: int, sigma: float) -> tuple[Kernel, float]:
    """The kernel of a width whose measured error is least, and that error: a coarse scan over the exponent, then finer ones."""
    low, high, best = 1.0 * width, 3.2 * width, None
    for _ in range(4):
        tried = [(Kernel(width, float(b), sigma).error(), float(b)) for b in np.linspace(low, high, 13)]
        error, beta = min(tried)
        step = (high - low) / 12
        low, high, best = max(0.1, beta - step), beta + step, (Kernel(width, beta, sigma), error)
    return best


def error_table(sigmas: tuple[float, ...] = SIGMAS) -> list[tuple[int, float, float, float]]:
    """width, sigma, beta and measured error of the best kernel of each width and oversampling."""
    return [(w, s, best_kernel(w, s)[0].beta, best_kernel(w, s)[1]) for s in sigmas for w in WIDTHS]


def for_accuracy(epsilon: float, ndim: int = 1, sigma: float = 2.0) -> Kernel:
    """The narrowest kernel whose measured error, once for each dimension, stays within ``epsilon`` with a margin."""
    low, high = WIDTHS[0], WIDTHS[-1] + 1
    while low < high:  # errors fall with the width
        width = (low + high) // 2
        low, high = (low, width) if best_kernel(width, sigma)[1] * ndim * MARGIN <= epsilon else (width + 1, high)
    if low <= WIDTHS[-1]:
        return best_kernel(low, sigma)[0]
    raise ValueError(f"no kernel reaches {epsilon:g} in {ndim} dimensions at an oversampling of {sigma:g}; the best is {best_epsilon(ndim, sigma_min=sigma, sigma_max=sigma):.1e}")


def candidate_sigmas(sigma_min: float, sigma_max: float) -> list[float]:
    if not 1.2 <= sigma_min <= sigma_max <= 2.51:
        raise ValueError("oversampling must lie between 1.2 and 2.5")
    return sorted({s for s in SIGMAS if sigma_min <= s <= sigma_max} | {sigma_max})


def best_epsilon(ndim: int, singleprec: bool = False, sigma_min: float = 1.2, sigma_max: float = 2.5) -> float:
    """The least error that any kernel of the table reaches in so many dimensions, or the precision of the numbers."""
    reached = min(best_kernel(w, s)[1] for w in WIDTHS for s in candidate_sigmas(sigma_min, sigma_max))
    return max(reached * ndim * MARGIN, 6e-8 * 4 if singleprec else 1.2e-16 * 8 * ndim)


def chosen(epsilon: float, modes: list[int], points: float, sigma_min: float = 1.2, sigma_max: float = 2.5) -> Kernel:
    """The kernel of least expected work: kernel values of all points, and the transform of the finer grid."""
    found, ndim = [], len(modes)
    for sigma in candidate_sigmas(sigma_min, sigma_max):
        try:
            kernel = for_accuracy(epsilon, ndim, sigma)
        except ValueError:
            continue
        cells = math.prod(sigma * n for n in modes)
        found.append((points * kernel.width**ndim + 10 * cells * math.log2(max(2.0, cells)), sigma, kernel))
    if not found:
        raise ValueError(f"no kernel reaches {epsilon:g} in {ndim} dimensions; the best is {best_epsilon(ndim, sigma_min=sigma_min, sigma_max=sigma_max):.1e}")
    return min(found, key=lambda x: x[:2])[2]
