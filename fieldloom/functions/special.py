"""Special functions that neither Spark SQL nor NumPy has."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(a)]).reshape(np.shape(a))


def incomplete_gamma(a: float | np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): a power series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(x, np.float64))
    out = np.zeros(x.shape)
    if not x.size:
        return out
    low = (x > 0) & (x < a + 1)
    if low.any():
        k, z = a[low], x[low]
        term = 1.0 / k
        total = term.copy()
        for n in range(1, 500):
            term = term * z / (k + n)
            total += term
            if (term < total * 1e-17).all():
                break
        out[low] = total * np.exp(k * np.log(z) - z - log_gamma(k))
    high = (x >= a + 1) & np.isfinite(x)
    if high.any():
        k, z = a[high], x[high]
        tiny = 1e-300
        b = z + 1 - k
        c = np.full_like(z, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for n in range(1, 500):
            step = -n * (n - k)
            b = b + 2
            d = step * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            delta = d * c
            h *= delta
            if (np.abs(delta - 1) < 1e-16).all():
                break
        out[high] = 1 - np.exp(k * np.log(z) - z - log_gamma(k)) * h
    out[np.isposinf(x)] = 1.0
    out[np.isnan(x)] = np.nan
    return out


#: Coefficients of a published rational approximation of the normal quantile (relative error 1.2e-9).
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, by rational approximation."""
    u = np.asarray(u, np.float64)
    out = np.full_like(u, np.nan)
    middle = (u >= QUANTILE_TAIL) & (u <= 1 - QUANTILE_TAIL)
    q = u[middle] - 0.5
    r = q * q
    out[middle] = _horner(QUANTILE_A, r) * q / (_horner(QUANTILE_B, r) * r + 1)
    for tail, sign in (((u > 0) & (u < QUANTILE_TAIL), 1.0), ((u < 1) & (u > 1 - QUANTILE_TAIL), -1.0)):
        p = u[tail] if sign > 0 else 1 - u[tail]
        q = np.sqrt(-2 * np.log(p))
        out[tail] = sign * _horner(QUANTILE_C, q) / (_horner(QUANTILE_D, q) * q + 1)
    out[u == 0], out[u == 1] = -np.inf, np.inf
    return out


def normal_quantile_column(u: Column) -> Column:
    """The same approximation as one column expression."""
    q, r = u - 0.5, (u - 0.5) * (u - 0.5)
    lower, upper = F.sqrt(-2.0 * F.log(u)), F.sqrt(-2.0 * F.log(1.0 - u))

    def tail(x: Column) -> Column:
        return _horner(tuple(map(F.lit, QUANTILE_C)), x) / (_horner(tuple(map(F.lit, QUANTILE_D)), x) * x + 1.0)

    middle = _horner(tuple(map(F.lit, QUANTILE_A)), r) * q / (_horner(tuple(map(F.lit, QUANTILE_B)), r) * r + 1.0)
    return F.when(u < QUANTILE_TAIL, tail(lower)).when(u > 1 - QUANTILE_TAIL, -tail(upper)).otherwise(middle)
