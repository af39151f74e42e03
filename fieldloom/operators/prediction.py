"""Prediction intervals and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import md5_uniform
from ..functions.special import normal_quantile_column

Z95 = 1.96


def metrics(predicted: DataFrame) -> DataFrame:
    """n, mspe, rmspe (percent; observations near zero add nothing), coverage of mean +- 1.96 sd."""
    error = F.col("mean") - F.col("obs")
    relative = F.when(F.abs("obs") > 1e-5, 100.0 * error / F.col("obs")).otherwise(F.lit(0.0))
    sd = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    inside = F.col("obs").between(F.col("mean") - Z95 * sd, F.col("mean") + Z95 * sd)
    return predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mspe"),
        F.sqrt(F.avg(relative * relative)).alias("rmspe"),
        F.avg(inside.cast("double")).alias("coverage"),
    )


def draws(predicted: DataFrame, simulations: int, seed: int) -> DataFrame:
    """point_id, obs, draw: Gaussian draws of every prediction, from reproducible uniforms."""
    each = predicted.select("point_id", "obs", "mean", "var", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("k"))
    u = md5_uniform(F.concat_ws(":", F.col("point_id").cast("string"), F.col("k").cast("string")), seed)
    eps = 1e-15
    normal = normal_quantile_column(F.greatest(F.least(u, F.lit(1.0 - eps)), F.lit(eps)))
    return each.select("point_id", "obs", (F.col("mean") + F.sqrt(F.greatest(F.col("var"), F.lit(0.0))) * normal).alias("draw"))


def sample_moments(drawn: DataFrame) -> DataFrame:
    """point_id, obs, mean, var: sample mean and population variance of the draws of each point."""
    d = F.col("draw")
    return drawn.groupBy("point_id", "obs").agg(F.avg(d).alias("mean"), F.avg(d * d).alias("mean2")).select("point_id", "obs", "mean", F.greatest(F.col("mean2") - F.col("mean") * F.col("mean"), F.lit(0.0)).alias("var"))
