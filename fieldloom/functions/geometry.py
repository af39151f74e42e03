"""Expressions over coordinate columns x1, x2, ... and reproducible uniforms."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinates(df: DataFrame, prefix: str = "x") -> list[str]:
    """Names of the coordinate columns, in order."""
    found = [c for c in df.columns if re.fullmatch(rf"{prefix}\d+", c)]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def squared_distance(a: Sequence[Column], b: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Sum of squared differences (times weights) by subtraction, product and sum in order, so that other engines agree to the bit."""
    out = None
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        term = (p - q) * (p - q)
        if weights is not None:
            term = term * F.lit(float(weights[k]))
        out = term if out is None else out + term
    return out


def array_squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def md5_uniform(key: Column, seed: int) -> Column:
    """A uniform in [0, 1) from the first 13 hexadecimal digits of md5(key-seed)."""
    text = F.concat(key.cast("string"), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def md5_order(key: Column, seed: int) -> Column:
    """A string whose order is a seeded random order of keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")).cast("binary"))


def unit_ball_volume(d: int) -> float:
    return math.pi ** (d / 2) / math.gamma(d / 2 + 1)


def distance_threshold(scale: Sequence[float], n: int, m: int, multiplier: float) -> float:
    """Radius that holds about m * multiplier of n points, from the coordinates whose scale is under 1 (one at least)."""
    relevant = [s for s in scale if s < 1]
    d = max(1, len(relevant))
    density = n * math.prod(relevant)
    return 1.2 * (m * multiplier / density / unit_ball_volume(d)) ** (1 / d)
