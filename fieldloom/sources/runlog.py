"""Sinks: a run's log row and its parameter vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The columns of a run's log row.
TIMINGS = ("RAC_partitioning", "centers_of_gravity_calculation", "send_centers_of_gravity", "reorder_centers", "create_block_info", "block_sending", "nn_searching", "gpu_copy", "computation", "gpu_total", "cleanup_gpu", "total", "total_gflops")
COUNTS = ("numPointsPerProcess", "numPointsTotal", "numBlocksPerProcess", "numBlocksTotal", "m", "seed")
QUALITY = ("mspe", "rmspe", "ci_coverage", "optimized_log_likelihood")
LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in TIMINGS] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in QUALITY] + [T.StructField("iters", T.LongType())]
)


def log_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    """One row of the log; what is not given is null."""
    unknown = set(values) - set(LOG_SCHEMA.names)
    if unknown:
        raise ValueError(f"unknown log columns: {', '.join(sorted(unknown))}")
    row = [None if values.get(f.name) is None else (int if isinstance(f.dataType, T.LongType) else float)(values[f.name]) for f in LOG_SCHEMA]
    return spark.createDataFrame([tuple(row)], LOG_SCHEMA)


def append_log(row: DataFrame, path: str, kind: str = "csv") -> None:
    writer = row.write.mode("append")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def append_theta(spark: SparkSession, theta: tuple[float, ...], path: str) -> None:
    """The whole parameter vector as one line."""
    spark.createDataFrame([(",".join(repr(float(t)) for t in theta),)], "value string").write.mode("append").text(path)


def run_name(n: int, blocks: int, m: int, seed: int, scaled: bool, suffix: str = "") -> str:
    return f"points_{n}_blocks_{blocks}_m_{m}_seed_{seed}_scaled_{int(scaled)}{suffix}"
