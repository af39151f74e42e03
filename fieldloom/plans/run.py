"""A whole run: load, prepare, estimate, predict, log."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, estimation, flops, likelihood, neighbors, prediction
from ..sources import points as src
from ..sources import runlog
from .config import Options, initial_theta, unpack


@dataclass
class Result:
    theta: tuple[float, ...]
    loglik: float | None
    evaluations: int
    metrics: dict[str, float]
    seconds: dict[str, float] = field(default_factory=dict)
    log: DataFrame | None = None


def load(spark: SparkSession, path: str, n: int, o: Options, seed: int) -> DataFrame:
    """The first n points of a file; without a file, uniform points."""
    if path:
        return src.first_points(src.read_csv_points(spark, path, o.dim), n)
    return src.uniform_points(spark, n, o.dim, seed, observe=o.maxeval != 1)


def predict(prepared: estimation.Prepared, test: DataFrame, o: Options, theta: tuple[float, ...]) -> dict[str, float]:
    """Conditional means and variances of the test points, Monte-Carlo intervals, and their quality."""
    scaled = blocks.scaled(test, o.distance_scale)
    assigned, _ = blocks.finer_partition(scaled, o.num_total_blocks_test, o.clustering, o.kmeans_max_iter, o.seed)
    order = blocks.ordered_blocks(blocks.centroids(assigned), o.seed)
    coarse, _ = estimation.radii(o, prepared.points.count(), o.m_test)
    candidates = None
    if coarse is not None:
        train = blocks.centroids(prepared.points.drop("ord")).join(prepared.points.select("cid", "ord").distinct(), "cid")
        candidates = neighbors.candidate_range_join(train, order, coarse)
    near = estimation.neighbours_within(order, prepared.points, candidates, o.m_test, coarse, is_test=True)
    table = likelihood.block_table(blocks.unscaled(assigned, o.distance_scale), blocks.unscaled(near, o.distance_scale))
    found = likelihood.block_predictions(table, unpack(o, theta), o.kernel_type, o.anchor_loc, o.anchor_val)
    found = found.select(F.concat_ws("/", F.col("cid").cast("string"), F.col("place").cast("string")).alias("point_id"), "obs", "mean", "var")
    sampled = prediction.sample_moments(prediction.draws(found, o.num_simulations, o.seed))
    return prediction.metrics(sampled).first().asDict()


def run(spark: SparkSession, options: Options, train: DataFrame | None = None, test: DataFrame | None = None) -> Result:
    """Modes: estimation fits; prediction uses the initial parameters; full fits, then predicts."""
    o = options.checked()
    began = time.time()
    train = load(spark, o.train_path, o.num_total_points, o, o.seed + 1) if train is None else train
    result = Result(initial_theta(o), None, 0, {})
    if o.mode == "prediction":
        prepared = estimation.prepare(train, o)
    else:
        found, prepared = estimation.fit(train, o)
        result = Result(found.x, found.value, found.evaluations, {})
    result.seconds |= prepared.seconds
    if o.mode != "estimation":
        test = load(spark, o.test_path, o.num_total_points_test, o, o.seed + 2) if test is None else test
        result.metrics = predict(prepared, test, o, result.theta)
    result.seconds["total"] = time.time() - began
    blocks_n = prepared.table.count()
    values = {
        "total": result.seconds["total"],
        **{name: result.seconds.get(name) for name in runlog.TIMINGS if name not in ("total", "total_gflops")},
        "total_gflops": flops.gflops(prepared.sizes, o.dim).first()[0],
        "numPointsTotal": prepared.points.count(),
        "numBlocksTotal": blocks_n,
        "m": o.m,
        "seed": o.seed,
        "mspe": result.metrics.get("mspe"),
        "rmspe": result.metrics.get("rmspe"),
        "ci_coverage": result.metrics.get("coverage"),
        "optimized_log_likelihood": result.loglik,
        "iters": result.evaluations,
    }
    result.log = runlog.log_row(spark, values)
    if o.log_append:
        name = runlog.run_name(o.num_total_points, blocks_n, o.m, o.seed, len(set(o.distance_scale)) > 1)
        runlog.append_log(result.log, f"{o.log_append}/{name}")
        runlog.append_theta(spark, result.theta, f"{o.log_append}/theta_{name}")
    prepared.release()
    return result
