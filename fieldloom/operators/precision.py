"""Double against single precision: exact conditional log-likelihoods over a grid of trials."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import matern_general

NOISE = 1e-6
JITTER = 1e-3
FAILED = -1e10
SIZES = (10, 20, 50, 80)
SMOOTHNESS = (0.5, 1.5, 2.5)


def disc(n: float, points: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(inner, ring) points of the disc of radius 1 / n, the inner ones within 1 / (n sqrt 3)."""
    rng = np.random.default_rng(seed)
    radius, angle = np.sqrt(rng.random(points)) / n, 2 * np.pi * rng.random(points)
    xy = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    inner = radius <= 1 / (n * math.sqrt(3))
    return xy[inner], xy[~inner]


def gram(a: np.ndarray, b: np.ndarray, nu: float, dtype) -> np.ndarray:
    a, b = a.astype(dtype), b.astype(dtype)
    d2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return matern_general(1.0, d2, nu).astype(dtype)


def robust_cholesky(k: np.ndarray) -> np.ndarray:
    """Cholesky factor, with jitter on the diagonal if it fails the first time."""
    try:
        return np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(k + JITTER * np.eye(len(k), dtype=k.dtype))


def sample_prior(x: np.ndarray, nu: float, samples: int, dtype=np.float64, seed: int = 0) -> np.ndarray:
    """Draws from the process at x, one a row."""
    k = gram(x, x, nu, dtype) + dtype(NOISE) * np.eye(len(x), dtype=dtype)
    z = np.random.default_rng(seed).standard_normal((samples, len(x))).astype(dtype)
    return z @ robust_cholesky(k).T


def conditional(train: np.ndarray, y: np.ndarray, test: np.ndarray, nu: float, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Conditional mean and covariance of the test points."""
    k = gram(train, train, nu, dtype) + dtype(NOISE) * np.eye(len(train), dtype=dtype)
    cross = gram(train, test, nu, dtype)
    try:
        factor = robust_cholesky(k)
        w = np.linalg.solve(factor, cross)
        return w.T @ np.linalg.solve(factor, y.astype(dtype)), gram(test, test, nu, dtype) - w.T @ w
    except np.linalg.LinAlgError:
        solved = np.linalg.solve(k, np.column_stack([cross, y[:, None]]).astype(dtype))
        return cross.T @ solved[:, -1], gram(test, test, nu, dtype) - cross.T @ solved[:, :-1]


def conditional_loglik(y: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    """Log-density with -(n / 2) log(2 pi); FAILED if the covariance has no factor."""
    try:
        factor = robust_cholesky(cov + cov.dtype.type(NOISE) * np.eye(len(cov), dtype=cov.dtype))
        z = np.linalg.solve(factor, (y - mean).astype(cov.dtype))
    except np.linalg.LinAlgError:
        return FAILED
    return float(-0.5 * (z @ z) - np.log(np.diag(factor)).sum() - 0.5 * len(y) * math.log(2 * math.pi))


def precision_grid(spark: SparkSession, trials: int, sizes=SIZES, smoothness=SMOOTHNESS, points: int = 600) -> DataFrame:
    """n, nu, precision, trial, loglik, cond, memory_kb, failed: one row for each trial; trials are dealt to tasks."""
    grid = spark.range(trials).select(F.col("id").cast("int").alias("trial"), F.explode(F.array(*map(F.lit, sizes))).alias("n"), F.lit(None).alias("_"))
    grid = grid.select("trial", "n", F.explode(F.array(*map(F.lit, smoothness))).alias("nu"))
    grid = grid.select("trial", "n", "nu", F.explode(F.array(F.lit("double"), F.lit("single"))).alias("precision"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            dtype = np.float64 if r.precision == "double" else np.float32
            inner, ring = disc(r.n, points, int(r.trial))
            y = np.zeros(len(ring))
            mean, cov = conditional(ring, y, inner, r.nu, dtype)
            value = conditional_loglik(np.zeros(len(inner)), mean, cov)
            k = gram(ring, ring, r.nu, dtype) + dtype(NOISE) * np.eye(len(ring), dtype=dtype)
            memory = (k.nbytes + cov.nbytes + len(ring) * len(inner) * k.itemsize) / 1024
            rows.append((r.n, r.nu, r.precision, r.trial, value, float(np.linalg.cond(k)), memory, value == FAILED))
        return pd.DataFrame(rows, columns=["n", "nu", "precision", "trial", "loglik", "cond", "memory_kb", "failed"])

    return grid.groupBy("n", "nu", "precision", "trial").applyInPandas(run, "n int, nu double, precision string, trial int, loglik double, cond double, memory_kb double, failed boolean")


def trial_stats(trials: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, least, largest and median of the finite values of each group."""
    v = F.col(value)
    finite = trials.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return finite.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.median(v).alias("median_v"))
