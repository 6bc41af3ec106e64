"""Covariance kernels, as columns for the relational layer and in numpy for batched linear algebra.

theta = (phi, sigmasq, nu, alpha), alpha being the nugget's share of sigmasq. At distance 0 a kernel is sigmasq, nugget
included; beyond it (1 - alpha) * sigmasq * rho(d). So two rows at one place are perfectly correlated, nugget and all;
locations are checked for duplicates where that matters.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MATERN, POWER_EXPONENTIAL, WAVE = 1, 0, 2


class Theta(NamedTuple):
    phi: float
    sigmasq: float = 1.0
    nu: float = 0.5
    alpha: float = 0.0


_HALF_INTEGERS = (0.5, 1.5, 2.5)


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """K_nu(x) for x > 0, the integral of exp(-x cosh t) cosh(nu t) over t >= 0.

    By the trapezoid rule, whose error for this integrand falls off exponentially in 1 / step: the step is as fine as the peak's width,
    1 / sqrt(x), asks for, and the sum ends where no digit is left. Values are taken in order, so that those of a batch ask for alike.
    """
    x = np.asarray(x, float)
    flat, out = x.ravel(), np.empty(x.size)
    order = np.argsort(flat, kind="stable")
    at = 0
    while at < flat.size:
        least = flat[order[at]]
        upto = min(at + 4096, max(at + 1, np.searchsorted(flat, 4 * least, "right", sorter=order)))
        part = flat[order[at:upto], None]
        step = min(0.12, 0.6 / math.sqrt(part[-1, 0]))
        end = math.acosh(1 + 50 / least)
        end = math.acosh(1 + (50 + abs(nu) * (end + 2)) / least)
        t = np.arange(0.0, end + step, step)
        weight = np.full(t.size, step)
        weight[0] /= 2
        # cosh(nu t) exp(-x (cosh t - 1)), its exponents taken together against overflow
        down = part * (np.cosh(t) - 1)[None, :]
        terms = np.exp(nu * t[None, :] - down) + np.exp(-nu * t[None, :] - down)
        out[order[at:upto]] = 0.5 * (terms @ weight) * np.exp(-part[:, 0])
        at = upto
    return out.reshape(x.shape)


def correlation(d: np.ndarray, theta: Theta, family: int = MATERN) -> np.ndarray:
    """rho(d) without the nugget."""
    d = np.asarray(d, float)
    phi, nu = theta.phi, theta.nu
    if family == POWER_EXPONENTIAL:
        return np.exp(-phi * d**nu)
    if family == WAVE:
        return np.exp(-phi * d) * np.cos(nu * d)
    if family != MATERN:
        raise ValueError(f"no covariance family {family}")
    t = d * phi
    if nu == 0.5:
        return np.exp(-t)
    if nu == 1.5:
        return (1 + t) * np.exp(-t)
    if nu == 2.5:
        return (1 + t + t * t / 3) * np.exp(-t)
    out = np.ones_like(t)
    far = t > 0
    out[far] = 2 ** (1 - nu) / math.gamma(nu) * t[far] ** nu * bessel_k(nu, t[far])
    return out


def covariance(d: np.ndarray, theta: Theta, family: int = MATERN) -> np.ndarray:
    d = np.asarray(d, float)
    return np.where(d == 0, theta.sigmasq, (1 - theta.alpha) * theta.sigmasq * correlation(d, theta, family))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the last two axes' rows: (..., n, d) and (..., m, d) give (..., n, m)."""
    return np.sqrt(((a[..., :, None, :] - b[..., None, :, :]) ** 2).sum(-1))


def covariance_column(d: Column, theta: Theta, family: int = MATERN) -> Column:
    """covariance() as a column; by closed forms in whole-stage code, but for the Matern family where nu is none of 1/2, 3/2, 5/2."""
    t = d * F.lit(theta.phi)
    if family == POWER_EXPONENTIAL:
        rho = F.exp(F.lit(-theta.phi) * F.pow(d, F.lit(theta.nu)))
    elif family == WAVE:
        rho = F.exp(-t) * F.cos(F.lit(theta.nu) * d)
    elif family != MATERN:
        raise ValueError(f"no covariance family {family}")
    elif theta.nu == 0.5:
        rho = F.exp(-t)
    elif theta.nu == 1.5:
        rho = (1 + t) * F.exp(-t)
    elif theta.nu == 2.5:
        rho = (1 + t + t * t / 3) * F.exp(-t)
    else:
        return general_matern(d, theta)
    return F.when(d == 0, F.lit(theta.sigmasq)).otherwise(F.lit((1 - theta.alpha) * theta.sigmasq) * rho)


#: Terms of a Chebyshev series for an octave of t = d phi; the octaves end at 2 ** LAST, beyond which rho is under 1e-27.
TERMS, LAST = 24, 6


@lru_cache(maxsize=64)
def octaves(nu: float) -> tuple[int, np.ndarray]:
    """The first octave and, one after the other, the Chebyshev coefficients of rho(t) exp(t) in [2 ** k, 2 ** (k + 1)] from it on.

    Below the first octave rho differs from 1 by less than 1e-16, or a series about 0 is as good: see general_matern().
    """
    first = -10 if by_series(nu) else -30
    nodes = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
    t = 2.0 ** np.arange(first, LAST)[:, None] * (1.5 + 0.5 * nodes)[None, :]
    values = correlation(t, Theta(1.0, nu=nu)) * np.exp(t)
    to = 2.0 / TERMS * np.cos(np.pi * np.arange(TERMS)[:, None] * (np.arange(TERMS) + 0.5)[None, :] / TERMS)
    to[0] /= 2
    return first, values @ to.T


def by_series(nu: float) -> bool:
    """Whether the series about 0 is used: where rho leaves 1 so soon that octaves would not reach. It fails at whole numbers."""
    return nu < 0.9


def general_matern(d: Column, theta: Theta) -> Column:
    """The Matern family for any nu, of column functions: there is no Bessel function in Spark, so each octave has its Chebyshev series."""
    nu, t = theta.nu, d * F.lit(theta.phi)
    first, table = octaves(nu)
    octave = F.least(F.greatest(F.floor(F.log2(t)).cast("int"), F.lit(first)), F.lit(LAST - 1))
    u = (t / F.pow(F.lit(2.0), octave) - 1.5) * 2
    terms = F.slice(F.lit(table[:, ::-1].ravel()), (octave - first) * TERMS + 1, F.lit(TERMS))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    rho = F.aggregate(terms, start, lambda s, c: F.struct((c + 2 * u * s["a"] - s["b"]).alias("a"), s["a"].alias("b")), lambda s: s["a"] - u * s["b"]) * F.exp(-t)
    if by_series(nu):  # Gamma(1 - nu) (S(-nu) - (t / 2) ** (2 nu) S(nu)), S(m) being the sum of (t / 2) ** (2 k) / (k! Gamma(k + m + 1))
        h = t * t / 4
        sums = [F.lit(1 / math.gamma(m + 1)) + h * (F.lit(1 / math.gamma(m + 2)) + h * F.lit(0.5 / math.gamma(m + 3))) for m in (-nu, nu)]
        near = F.lit(math.gamma(1 - nu)) * (sums[0] - F.pow(t / 2, F.lit(2 * nu)) * sums[1])
    else:
        near = F.lit(1.0)
    rho = F.when(t < 2.0**first, near).when(t >= 2.0**LAST, F.lit(0.0)).otherwise(rho)
    return F.when(d == 0, F.lit(theta.sigmasq)).otherwise(F.lit((1 - theta.alpha) * theta.sigmasq) * rho)


def has_closed_form(theta: Theta, family: int) -> bool:
    return family != MATERN or theta.nu in _HALF_INTEGERS
