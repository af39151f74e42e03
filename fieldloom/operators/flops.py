"""Operation counts of a likelihood evaluation, from block and neighbour sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factorisation(n: Column) -> Column:
    return n * n * n / 3.0 + n * n / 2.0 + n / 6.0


def gflops(sizes: DataFrame, d: int) -> DataFrame:
    """One row gflops from rows n (block size), m (neighbours)."""
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    covariance = (3.0 * d + 11.0) * (n * n + m * m + n * m)
    solves = m * m * n + m * m + n * n
    products = 2.0 * n * n * m + 2.0 * n * m
    updates = 2.0 * n * n + 2.0 * n + 8.0 * n
    total = covariance + factorisation(m) + factorisation(n) + solves + products + updates
    return sizes.agg((F.sum(total) / 1e9).alias("gflops"))
