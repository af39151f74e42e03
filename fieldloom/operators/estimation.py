"""Maximum-likelihood estimation: bounded derivative-free search on the driver, one Spark job for each evaluation."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import distance_threshold
from ..plans.config import Options, bounds, initial_theta, unpack
from . import blocks, likelihood, neighbors

log = logging.getLogger(__name__)
#: Fixed value: the default multiplier of the number of neighbours, which stands for no limit.
NO_LIMIT = 99_999


@dataclass
class Optimum:
    x: tuple[float, ...]
    value: float
    evaluations: int
    trace: list[tuple] = field(default_factory=list)


class _Budget(Exception):
    pass


def simplex_search(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, active: np.ndarray, tolerance: float) -> tuple[np.ndarray, float]:
    """Nelder-Mead minimisation over some coordinates, until the simplex shrinks to ``tolerance`` of its first size."""
    n = len(active)
    points = [start.copy()]
    for k in active:
        p = start.copy()
        p[k] += step[k] if step[k] else 1e-3
        points.append(p)
    values = [f(p) for p in points]
    first = max(np.abs(p - points[0]).max() for p in points[1:])
    for _ in range(200 * n):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= tolerance * first:
            break
        middle = np.mean(points[:-1], axis=0)

        def at(t: float, middle=middle, worst=points[-1]) -> np.ndarray:
            return middle + t * (middle - worst)

        reflected = at(1.0)
        fr = f(reflected)
        if fr < values[0]:
            further = at(2.0)
            fe = f(further)
            points[-1], values[-1] = (further, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = at(0.5 if fr < values[-1] else -0.5)
            fi = f(inner)
            if fi < min(fr, values[-1]):
                points[-1], values[-1] = inner, fi
            else:
                for k in range(1, n + 1):
                    points[k] = points[0] + 0.5 * (points[k] - points[0])
                    values[k] = f(points[k])
    best = int(np.argmin(values))
    return points[best], values[best]


def maximise(objective: Callable[[tuple[float, ...]], float], start: Sequence[float], low: Sequence[float], high: Sequence[float], maxeval: int = 5000, xtol_rel: float = 1e-5, ftol_rel: float = 1e-5) -> Optimum:
    """Subspace-searching simplex: coordinates are ordered by how far they moved, cut into subspaces of up to five, and each is searched by a simplex."""
    low, high = np.minimum(low, high).astype(float), np.maximum(low, high).astype(float)
    x = np.clip(np.asarray(start, float), low, high)
    trace: list[tuple] = []
    seen = Optimum(tuple(x), -math.inf, 0, trace)

    def f(p: np.ndarray) -> float:
        p = np.clip(p, low, high)
        if seen.evaluations >= maxeval:
            raise _Budget
        value = objective(tuple(p.tolist()))
        seen.evaluations += 1
        trace.append((seen.evaluations, tuple(p.tolist()), value))
        if value > seen.value:
            seen.x, seen.value = tuple(p.tolist()), value
        return -value if math.isfinite(value) else math.inf

    step = np.where(x != 0, 0.25 * np.abs(x), 0.05 * (high - low))
    step = np.minimum(step, 0.5 * (high - low))
    try:
        value = f(x)
        for _ in range(1000):
            before, old = x.copy(), value
            order = np.argsort(-np.abs(step), kind="stable")
            for start_at in range(0, len(order), 5):
                x, value = simplex_search(f, x, step, order[start_at : start_at + 5], 0.1)
                x = np.clip(x, low, high)
            moved = x - before
            small_x = (np.maximum(np.abs(moved), np.abs(step) * 0.25) <= xtol_rel * np.maximum(np.abs(x), 1e-12)).all()
            if small_x or (old - value <= ftol_rel * abs(value) and np.abs(step).max() <= 1e-2 * np.abs(x).max()):
                break
            factor = np.clip(np.abs(moved).sum() / max(np.abs(step).sum(), 1e-300), 0.1, 4.0)
            step = np.where(moved != 0, np.copysign(np.abs(step) * factor, moved), -step * factor)
    except _Budget:
        pass
    return seen


@dataclass
class Prepared:
    """A block table that is kept in memory while parameters vary, and the stage timings of its making."""

    table: DataFrame
    seconds: dict[str, float]
    points: DataFrame  # scaled, with cid and ord
    sizes: DataFrame  # n, m of every block
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()


def radii(o: Options, n: int, m: int) -> tuple[float | None, float | None]:
    """(coarse, finer) radius of the neighbour search: as given, else from m, n, the scale and ``nn_multiplier``; None: no limit.

    A multiplier of the default's size makes radii that no pair exceeds.
    """
    derived = distance_threshold(o.distance_scale, n, m, o.nn_multiplier) if o.nn_multiplier < NO_LIMIT and n else None
    return tuple(derived if given is None else given for given in (o.distance_threshold_coarse, o.distance_threshold_finer))


def neighbours_within(order: DataFrame, points: DataFrame, candidates: DataFrame | None, m: int, radius: float | None, is_test: bool = False) -> DataFrame:
    """Each block's m nearest points within the radius, filled up from its candidate blocks where they are too few."""
    near = neighbors.nearest_earlier(order, points, m, radius, is_test)
    return near if candidates is None else neighbors.filled(near, candidates, order, points, m)


def prepare(points: DataFrame, options: Options) -> Prepared:
    """Scale, block, order, find neighbours, unscale, and persist the block table."""
    o = options.checked()
    seconds: dict[str, float] = {}
    began = time.time()

    def lap(name: str) -> None:
        nonlocal began
        seconds[name] = time.time() - began
        began = time.time()

    scaled = blocks.scaled(points, o.distance_scale).persist()
    assigned, centers = blocks.finer_partition(scaled, o.num_total_blocks, o.clustering, o.kmeans_max_iter, o.seed)
    assigned = assigned.persist()
    n = assigned.count()
    lap("RAC_partitioning")
    means = blocks.centroids(assigned).persist()
    n_blocks = means.count()
    lap("centers_of_gravity_calculation")
    order = blocks.ordered_blocks(means, o.seed).persist()
    order.count()
    lap("reorder_centers")
    placed = neighbors.with_order(assigned, order).persist()
    placed.count()
    lap("create_block_info")
    coarse, finer = radii(o, n, o.m)
    candidates = None if coarse is None else neighbors.candidate_order_join(order, coarse, classic=n_blocks == n)
    near = neighbours_within(order, placed, candidates, o.m, finer).persist()
    near.count()
    lap("nn_searching")
    table = likelihood.block_table(blocks.unscaled(assigned, o.distance_scale), blocks.unscaled(near, o.distance_scale))
    table = table.repartition(points.sparkSession.sparkContext.defaultParallelism).persist()
    table.count()
    lap("gpu_copy")
    near.unpersist()
    means.unpersist()
    sizes = table.select(F.size("py").alias("n"), F.size("ny").alias("m"))
    return Prepared(table, seconds, placed, sizes, (table, placed, order, assigned, scaled))


def fit(points: DataFrame, options: Options) -> tuple[Optimum, Prepared]:
    """The best parameters found; failures of a block make a parameter vector infinitely bad."""
    o = options.checked()
    prepared = prepare(points, o)
    theta0 = initial_theta(o)
    low, high = bounds(o, theta0)

    def objective(theta: tuple[float, ...]) -> float:
        value = likelihood.block_loglik(prepared.table, unpack(o, theta), o.kernel_type, o.precision, o.anchor_loc, o.anchor_val).first()["loglik"]
        log.info("theta %s loglik %s", theta, value)
        return float("-inf") if value is None or math.isnan(value) else value

    began = time.time()
    found = maximise(objective, theta0, low, high, o.maxeval, o.xtol_rel, o.ftol_rel)
    prepared.seconds["computation"] = time.time() - began
    return found, prepared


def trace_frame(spark: SparkSession, found: Optimum) -> DataFrame:
    return spark.createDataFrame([(i, list(x), v) for i, x, v in found.trace], "evaluation int, theta array<double>, loglik double")
