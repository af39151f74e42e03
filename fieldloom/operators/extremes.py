"""Marginal transform of the spatial conditional extremes model (two coordinates).

With the distance h to the anchor: delta(h) = 1 + exp(-(h / delta1)**2), a = x0 exp(-(h / lambda)**kappa),
b = 1 + a**beta, z = (y - a) / b. z follows a delta-Laplace law; its distribution function, clamped, gives the
latent normal value. The log-density terms enter the likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import coordinates
from ..functions.special import incomplete_gamma, log_gamma, normal_quantile_column

CLAMP = {"double": 1e-12, "float": 1e-7}


def terms(points: DataFrame, parameters: dict[str, float], anchor: Sequence[float], anchor_value: float) -> DataFrame:
    """points with h, delta, a, b, z."""
    if anchor_value < 0:
        raise ValueError("the anchor's value must not be negative")
    xs = coordinates(points)
    if len(xs) != 2:
        raise ValueError("the extremes model is defined for two coordinates")
    dx, dy = F.col(xs[0]) - F.lit(float(anchor[0])), F.col(xs[1]) - F.lit(float(anchor[1]))
    p = parameters
    return (
        points.withColumn("h", F.sqrt(dx * dx + dy * dy))
        .withColumn("delta", 1.0 + F.exp(-(F.col("h") / p["delta1"]) * (F.col("h") / p["delta1"])))
        .withColumn("a", F.lit(float(anchor_value)) * F.exp(-F.pow(F.col("h") / p["lambda_a"], F.lit(p["kappa_a"]))))
        .withColumn("b", 1.0 + F.pow(F.col("a"), F.lit(p["beta"])))
        .withColumn("z", (F.col("obs") - F.col("a")) / F.col("b"))
    )


def _gamma_terms(delta: Column, x: Column) -> Column:
    """Struct (lg, p): log Gamma(1 / delta) and P(1 / delta, x); the JVM has neither."""

    @F.pandas_udf("lg double, p double")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for d, v in batches:
            a = 1.0 / d.to_numpy(np.float64)
            yield pd.DataFrame({"lg": log_gamma(a), "p": incomplete_gamma(a, v.to_numpy(np.float64))})

    return both(delta, x)


def densities(with_terms: DataFrame, parameters: dict[str, float]) -> DataFrame:
    """with_terms with log_f (delta-Laplace log-density of z) and u (its distribution function)."""
    tau, mu = parameters["tau"], parameters["mu"]
    x = F.pow(F.abs(F.col("z") - mu) / tau, F.col("delta"))
    g = with_terms.withColumn("g", _gamma_terms(F.col("delta"), x))
    log_f = F.log(F.col("delta") / (2.0 * tau)) - F.col("g.lg") - x
    return g.withColumn("log_f", log_f).withColumn("u", 0.5 + 0.5 * F.signum(F.col("z") - mu) * F.col("g.p")).drop("g")


def latent(with_densities: DataFrame, precision: str = "double") -> DataFrame:
    """with_densities with y, the latent normal value."""
    eps = CLAMP[precision]
    u = F.greatest(F.least(F.col("u"), F.lit(1.0 - eps)), F.lit(eps))
    return with_densities.withColumn("y", normal_quantile_column(u))


def transformed(points: DataFrame, parameters: dict[str, float], anchor: Sequence[float], anchor_value: float, precision: str = "double") -> DataFrame:
    """points with every term of the transform up to the latent y."""
    return latent(densities(terms(points, parameters, anchor, anchor_value), parameters), precision)


def jacobian_sums(with_latent: DataFrame) -> DataFrame:
    """One row: sums of log f, log b and y**2 / 2, counted once."""
    return with_latent.agg(F.sum("log_f").alias("sum_log_f"), F.sum(F.log("b")).alias("sum_log_b"), F.sum(0.5 * F.col("y") * F.col("y")).alias("half_sum_y2"))
