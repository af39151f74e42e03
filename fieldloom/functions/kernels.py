"""Covariance functions, each as a column expression and as a NumPy function of the scaled squared distance.

The scaled squared distance is the sum of squared coordinate differences times 1 / range**2. Ranges are
lengths; callers pass their inverse squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kernel:
    """``column(variance, d2, smoothness)`` and ``array(variance, d2, smoothness)`` compute the same covariance."""

    name: str
    column: Callable[[float, Column, float], Column]
    array: Callable[[float, np.ndarray, float], np.ndarray]
    has_smoothness: bool = False


def _matern(name: str, order: float, coefficients: tuple[float, ...]) -> Kernel:
    """variance * (1 + c1 s + c2 s^2 + ...) * exp(-s) with s = sqrt(2 order) r."""
    factor = math.sqrt(2.0 * order)

    def column(variance: float, d2: Column, smoothness: float = 0.0) -> Column:
        s = F.lit(factor) * F.sqrt(d2)
        poly, power = F.lit(1.0), None
        for c in coefficients:
            power = s if power is None else power * s
            poly = poly + power * F.lit(c)
        return F.lit(variance) * poly * F.exp(-s)

    def array(variance: float, d2: np.ndarray, smoothness: float = 0.0) -> np.ndarray:
        s = factor * np.sqrt(d2)
        poly, power = 1.0, None
        for c in coefficients:
            power = s if power is None else power * s
            poly = poly + power * c
        return variance * poly * np.exp(-s)

    return Kernel(name, column, array)


MATERN12 = _matern("matern12", 0.5, ())
MATERN32 = _matern("matern32", 1.5, (1.0,))
MATERN52 = _matern("matern52", 2.5, (1.0, 1.0 / 3.0))
MATERN72 = _matern("matern72", 3.5, (1.0, 2.0 / 5.0, 1.0 / 15.0))
POWEXP = Kernel(
    "powexp",
    lambda variance, d2, smoothness: F.lit(variance) * F.exp(-F.pow(F.sqrt(d2), F.lit(smoothness))),
    lambda variance, d2, smoothness: variance * np.exp(-np.power(np.sqrt(d2), smoothness)),
    has_smoothness=True,
)
EXPONENTIAL = Kernel(
    "exponential",
    lambda variance, d2, smoothness=0.0: F.lit(variance) * F.exp(-F.sqrt(d2)),
    lambda variance, d2, smoothness=0.0: variance * np.exp(-np.sqrt(d2)),
)

#: The extension point: another kernel is one more entry.
KERNELS: dict[str, Kernel] = {k.name: k for k in (MATERN12, MATERN32, MATERN52, MATERN72, POWEXP, EXPONENTIAL)}
ALIASES = {"exp": "matern12", "rbf": "exponential", "powerexponential": "powexp", "power_exponential": "powexp"}


def kernel(name: str) -> Kernel:
    key = name.lower().replace("-", "").replace(" ", "")
    found = KERNELS.get(ALIASES.get(key, key))
    if found is None:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(sorted(KERNELS))}")
    return found


def matern_general(variance: float, d2: np.ndarray, nu: float) -> np.ndarray:
    """Matérn covariance of any smoothness; half-integers up to 7/2 take their closed forms.

    Otherwise the Bessel function K_nu is integrated: K_nu(x) = integral over t >= 0 of exp(-x cosh t) cosh(nu t).
    """
    closed = {0.5: MATERN12, 1.5: MATERN32, 2.5: MATERN52, 3.5: MATERN72}.get(nu)
    if closed is not None:
        return closed.array(variance, d2, 0.0)
    s = np.sqrt(2.0 * nu) * np.maximum(np.sqrt(d2), 1e-12)
    t = np.linspace(0.0, 12.0, 2401)
    step = t[1] - t[0]
    weights = np.full(len(t), step)
    weights[0] = weights[-1] = step / 2
    with np.errstate(under="ignore", over="ignore"):
        bessel = (np.exp(-s[..., None] * np.cosh(t) + np.log(np.cosh(nu * t))) * weights).sum(axis=-1)
        out = variance * 2 ** (1 - nu) / math.gamma(nu) * s**nu * bessel
    return np.where(d2 == 0, variance, out)
