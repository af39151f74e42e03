"""Block-conditional Gaussian log-likelihood.

A block's members are modelled jointly, given its neighbours. With the joint covariance of (neighbours,
members) and its Cholesky factor, the last diagonal entries are those of the conditional covariance's factor
and the last entries of the forward solution are the standardised residuals; no triangular solver is needed.

Two values are reported: ``loglik`` leaves out -(n / 2) log(2 pi), ``loglik_full`` has it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import coordinates, squared_distance
from ..functions.kernels import kernel
from ..functions.marginal import transform
from ..plans.config import Theta

LOG_2PI = math.log(2 * math.pi)
#: Members from which on a block's points are merged by place.
MERGED_FROM = 256
#: Matrix rows of a block up to which blocks of a batch are factored together, and numbers of such a group's matrices, at most.
JOINED_TO, JOINED = 256, 1 << 14
#: Members of one place that meet others together in a long matrix, at most; shares that a block's rows are dealt to there.
TOGETHER, SHARES = 64, 16


def inverse_squares(ranges: Sequence[float]) -> list[float]:
    return [1.0 / (r * r) for r in ranges]


def covariance_long(assigned: DataFrame, theta: Theta, kernel_type: str, digits: int | None = None) -> DataFrame:
    """cid, i, j, val (i <= j by point_id): the covariance matrix of every block in long form, nugget on its diagonal.

    Values are computed, and rounded where ``digits`` are given, for pairs of places; members of a place take them over.
    """
    xs = coordinates(assigned)
    at = W.partitionBy("cid", *xs).orderBy("point_id")
    numbered = assigned.select("cid", "point_id", *xs, F.floor((F.row_number().over(at) - 1) / TOGETHER).alias("part"))
    places = numbered.groupBy("cid", *xs, "part").agg(F.sort_array(F.collect_list("point_id")).alias("ids"))

    def side(p: str, share: Column) -> DataFrame:
        ends = [F.array_min("ids").alias(f"{p}first"), F.array_max("ids").alias(f"{p}last")]
        rows = places.select("cid", share.alias("share"), F.col("ids").alias(f"{p}ids"), *ends, *[F.col(x).alias(f"{p}{x}") for x in xs])
        return rows.repartition(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cid", "share")  # a given number is not coalesced: few rows make many pairs

    a = side("a_", F.pmod(F.xxhash64(*xs, "part"), F.lit(SHARES)).cast("int"))
    b = side("b_", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    d2 = squared_distance([F.col(f"a_{x}") for x in xs], [F.col(f"b_{x}") for x in xs], inverse_squares(theta.ranges))
    value = kernel(kernel_type).column(theta.variance, d2, theta.smoothness)
    other, same = (v if digits is None else F.round(v, digits) for v in (value, value + F.lit(theta.nugget)))
    pairs = a.join(b, ["cid", "share"]).where(F.col("a_first") <= F.col("b_last"))
    pairs = pairs.select("cid", "a_ids", "b_ids", other.alias("other"), F.when(F.col("b_first") <= F.col("a_last"), same).alias("same"))
    rows = pairs.select("cid", "b_ids", "other", "same", F.explode("a_ids").alias("i")).select("cid", "i", F.explode("b_ids").alias("j"), "other", "same")
    return rows.where(F.col("i") <= F.col("j")).select("cid", "i", "j", F.when(F.col("i") == F.col("j"), F.col("same")).otherwise(F.col("other")).alias("val"))


def conditional_one(points: DataFrame, neighbours: DataFrame, theta: Theta, kernel_type: str) -> DataFrame:
    """point_id, obs, mean, var of every point given at most one neighbour, in closed form.

    ``neighbours``: dest (point_id), x1.., obs with rank 1.
    """
    xs = coordinates(points)
    k0 = theta.variance + theta.nugget
    n = neighbours.where("rank = 1").select("dest", F.col("obs").alias("n_obs"), *[F.col(x).alias(f"n_{x}") for x in xs])
    d2 = squared_distance([F.col(x) for x in xs], [F.col(f"n_{x}") for x in xs], inverse_squares(theta.ranges))
    c = F.when(F.col("n_obs").isNull(), F.lit(0.0)).otherwise(kernel(kernel_type).column(theta.variance, d2, theta.smoothness))
    joined = points.join(n, points["point_id"] == n["dest"], "left").withColumn("c", c)
    mean = F.coalesce(F.col("c") / k0 * F.col("n_obs"), F.lit(0.0))
    return joined.select("point_id", "obs", mean.alias("mean"), (F.lit(k0) - F.col("c") * F.col("c") / k0).alias("var"))


def conditional_two(points: DataFrame, neighbours: DataFrame, theta: Theta, kernel_type: str) -> DataFrame:
    """The same given at most two neighbours, with the 2 x 2 factor unrolled."""
    xs = coordinates(points)
    k, w = kernel(kernel_type), inverse_squares(theta.ranges)
    k0 = theta.variance + theta.nugget

    def side(rank: int, p: str) -> DataFrame:
        return neighbours.where(F.col("rank") == rank).select(F.col("dest").alias(f"{p}dest"), F.col("obs").alias(f"{p}obs"), *[F.col(x).alias(f"{p}{x}") for x in xs])

    def cov(p: str, q: str) -> Column:
        return k.column(theta.variance, squared_distance([F.col(f"{p}{x}") for x in xs], [F.col(f"{q}{x}") for x in xs], w), theta.smoothness)

    n1, n2 = side(1, "n_"), side(2, "q_")
    joined = points.join(n1, points["point_id"] == n1["n_dest"], "left").join(n2, points["point_id"] == n2["q_dest"], "left")
    c1, c2, c12 = (F.coalesce(x, F.lit(0.0)) for x in (cov("", "n_"), cov("", "q_"), cov("n_", "q_")))
    y1, y2 = F.coalesce("n_obs", F.lit(0.0)), F.coalesce("q_obs", F.lit(0.0))
    root = math.sqrt(k0)
    solved = joined.select("point_id", "obs", c1.alias("c1"), c2.alias("c2"), (c12 / root).alias("l21"), y1.alias("y1"), y2.alias("y2"))
    solved = solved.withColumn("l22", F.sqrt(F.lit(k0) - F.col("l21") * F.col("l21")))
    solved = solved.withColumns({"w1": F.col("c1") / root, "z1": F.col("y1") / root})
    solved = solved.withColumns({"w2": (F.col("c2") - F.col("l21") * F.col("w1")) / F.col("l22"), "z2": (F.col("y2") - F.col("l21") * F.col("z1")) / F.col("l22")})
    return solved.select("point_id", "obs", (F.col("w1") * F.col("z1") + F.col("w2") * F.col("z2")).alias("mean"), (F.lit(k0) - F.col("w1") * F.col("w1") - F.col("w2") * F.col("w2")).alias("var"))


def loglik_of(conditional: DataFrame) -> DataFrame:
    """One row n, logdet, quad, loglik from conditional means and variances."""
    e = F.col("obs") - F.col("mean")
    sums = conditional.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("var")).alias("logdet"), F.sum(e * e / F.col("var")).alias("quad"))
    return sums.withColumn("loglik", -0.5 * (F.col("logdet") + F.col("quad")))


def block_table(assigned: DataFrame, neighbours: DataFrame) -> DataFrame:
    """cid, px (flat coordinates), py, nx, ny: one row for each block; the input of every likelihood evaluation."""
    xs = coordinates(assigned)

    def gathered(df: DataFrame, key: str, order: list[str], p: str) -> DataFrame:
        rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.array(*xs).alias("x"), "obs"))).alias("s"))
        return rows.select(F.col(key).alias(f"{p}cid"), F.flatten(F.transform("s", lambda r: r["x"])).alias(f"{p}x"), F.transform("s", lambda r: r["obs"]).alias(f"{p}y"))

    members = gathered(assigned, "cid", ["point_id"], "p")
    near = gathered(neighbours, "dest", ["rank"], "n")
    empty = F.array().cast("array<double>")
    joined = members.join(near, members["pcid"] == near["ncid"], "left")
    return joined.select(F.col("pcid").alias("cid"), "px", "py", F.coalesce("nx", empty).alias("nx"), F.coalesce("ny", empty).alias("ny"))


def covariance(a: np.ndarray, b: np.ndarray, theta: Theta, kernel_type: str, dtype: str = "double") -> np.ndarray:
    """Covariances of the points of a (rows) and of b (columns), without nugget."""
    kind = np.float32 if dtype == "float" else np.float64
    a, b = (a / np.asarray(theta.ranges)).astype(kind), (b / np.asarray(theta.ranges)).astype(kind)
    d2 = np.zeros((len(a), len(b)), kind)
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        d2 += diff * diff
    return kernel(kernel_type).array(theta.variance, d2, theta.smoothness).astype(kind)


def joint_covariance(x: np.ndarray, theta: Theta, kernel_type: str, dtype: str = "double") -> np.ndarray:
    cov = covariance(x, x, theta, kernel_type, dtype)
    cov[np.diag_indices(len(x))] += cov.dtype.type(theta.nugget)
    return cov


def forward(factor: np.ndarray, right: np.ndarray, step: int = 32) -> np.ndarray:
    """Solution of a lower triangular system by blocked substitution: a product for each strip, a small solve on its diagonal."""
    out = right.astype(factor.dtype, copy=True)
    for start in range(0, len(factor), step):
        stop = start + step
        out[start:stop] = np.linalg.solve(factor[start:stop, start:stop], out[start:stop])
        out[stop:] -= factor[stop:, start:stop] @ out[start:stop]
    return out


def block_terms(px, py, nx, ny, theta: Theta, kernel_type: str, dtype: str = "double") -> tuple[float, float, np.ndarray, np.ndarray, bool]:
    """(logdet, quad, conditional means, conditional variances, ok) of one block."""
    d = len(theta.ranges)
    x = np.concatenate([nx, px]).reshape(-1, d)
    y = np.concatenate([ny, py])
    m = len(ny)
    try:
        factor = np.linalg.cholesky(joint_covariance(x, theta, kernel_type, dtype))
    except np.linalg.LinAlgError:
        return 0.0, 0.0, np.zeros(len(py)), np.zeros(len(py)), False
    z = forward(factor, y)
    mean = factor[m:, :m] @ z[:m]
    lower = factor[m:, m:]
    return float(2 * np.log(np.diag(factor)[m:].astype(np.float64)).sum()), float((z[m:].astype(np.float64) ** 2).sum()), mean, np.maximum((lower * lower).sum(axis=1), 0.0), True


def merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(places, mean observation and number of points at each place, squares within places)."""
    places, at = np.unique(x, axis=0, return_inverse=True)
    at = at.reshape(-1)
    count = np.bincount(at, minlength=len(places)).astype(np.float64)
    mean = np.bincount(at, y, len(places)) / np.maximum(count, 1.0)
    return places, mean, count, float(((y - mean[at]) ** 2).sum())


def block_value(px, py, nx, ny, theta: Theta, kernel_type: str, dtype: str = "double") -> tuple[float, float, bool]:
    """(logdet, quad, ok) of one block; a large block has one row in its matrix for each place, not for each point.

    k points at one place are their mean, with a nugget of nugget / k, and k - 1 contrasts that only hold nugget.
    """
    d, s2 = len(theta.ranges), theta.nugget
    if len(py) < MERGED_FROM or s2 <= 0 or dtype != "double":
        logdet, quad, _, _, ok = block_terms(px, py, nx, ny, theta, kernel_type, dtype)
        return logdet, quad, ok
    near, near_y, near_k, _ = merged(nx.reshape(-1, d), ny)
    own, own_y, own_k, within = merged(px.reshape(-1, d), py)
    m, x = len(near_y), np.concatenate([near, own])
    cov = covariance(x, x, theta, kernel_type)
    cov[np.diag_indices(len(x))] += s2 / np.concatenate([near_k, own_k])
    try:
        factor = np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return 0.0, 0.0, False
    z = forward(factor, np.concatenate([near_y, own_y]))[m:]
    logdet = 2 * np.log(np.diag(factor)[m:]).sum() + np.log(own_k).sum() + (len(py) - len(own_y)) * math.log(s2)
    return float(logdet), float((z * z).sum() + within / s2), True


def joined_values(px: list, py: list, nx: list, ny: list, theta: Theta, kernel_type: str) -> tuple[float, float] | None:
    """(logdet, quad) of some blocks in one call; None where one has no factor.

    Blocks are filled up to the largest with rows of the identity, which add nothing. The observations are one more
    row under each matrix, so that its factor holds the forward solution there.
    """
    d = len(theta.ranges)
    m, n = (np.array([len(y) for y in ys]) for ys in (ny, py))
    size = int((m + n).max())
    x, y = np.zeros((len(py), size, d)), np.zeros((len(py), size))
    for k in range(len(py)):
        end = m[k] + n[k]
        x[k, : m[k]], x[k, m[k] : end] = nx[k].reshape(-1, d), px[k].reshape(-1, d)
        y[k, : m[k]], y[k, m[k] : end] = ny[k], py[k]
    x /= np.asarray(theta.ranges)
    d2, diff = np.zeros((2, len(py), size, size))
    for j in range(d):
        np.subtract(x[:, :, None, j], x[:, None, :, j], out=diff)
        diff *= diff
        d2 += diff
    whole = np.empty((len(py), size + 1, size + 1))
    whole[:, :size, :size] = kernel(kernel_type).array(theta.variance, d2, theta.smoothness)
    whole[:, :, size] = 0.0
    whole[:, size, :size] = y
    diagonal = whole.reshape(len(py), -1)[:, :: size + 2]
    diagonal[:, :size] += theta.nugget
    diagonal[:, size] = 1e300  # beyond any sum of squares: its own pivot is not used
    for k in np.flatnonzero(m + n < size):
        end = m[k] + n[k]
        whole[k, end:size, :size] = 0.0
        diagonal[k, end:size] = 1.0
    try:
        factor = np.linalg.cholesky(whole)
    except np.linalg.LinAlgError:
        return None
    member = np.arange(size) >= m[:, None]
    pivots, z = factor.reshape(len(py), -1)[:, :: size + 2][:, :size], factor[:, size, :size]
    return float(2 * np.log(pivots[member]).sum()), float((z[member] ** 2).sum())


def block_values(px: list, py: list, nx: list, ny: list, theta: Theta, kernel_type: str, dtype: str = "double") -> tuple[float, float, int]:
    """(logdet, quad, failed) of the blocks of a batch, small ones in groups of about equal size."""
    sizes = np.array([len(a) + len(b) for a, b in zip(py, ny, strict=True)], np.int64)
    logdet, quad, failed = 0.0, 0.0, 0
    joined = np.flatnonzero((sizes > 0) & (sizes <= JOINED_TO) & (dtype == "double"))
    joined = joined[np.argsort(-sizes[joined], kind="stable")]
    alone = np.setdiff1d(np.arange(len(py)), joined).tolist()
    at = 0
    while at < len(joined):
        group = joined[at : at + max(1, JOINED // int(sizes[joined[at]]) ** 2)].tolist()
        at += len(group)
        found = joined_values(*([v[k] for k in group] for v in (px, py, nx, ny)), theta, kernel_type)
        if found is None:
            alone += group
        else:
            logdet, quad = logdet + found[0], quad + found[1]
    for k in alone:
        one_logdet, one_quad, ok = block_value(px[k], py[k], nx[k], ny[k], theta, kernel_type, dtype)
        logdet, quad, failed = logdet + one_logdet, quad + one_quad, failed + (not ok)
    return logdet, quad, failed


def member_predictions(px, nx, ny, theta: Theta, kernel_type: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Conditional mean and variance of every member alone, given the neighbours, from one factor; None where there is none."""
    d = len(theta.ranges)
    members, near = px.reshape(-1, d), nx.reshape(-1, d)
    try:
        factor = np.linalg.cholesky(joint_covariance(near, theta, kernel_type))
    except np.linalg.LinAlgError:
        return None
    solved = forward(factor, np.column_stack([covariance(near, members, theta, kernel_type), ny]))
    w, z = solved[:, :-1], solved[:, -1]
    return w.T @ z, np.maximum(theta.variance + theta.nugget - (w * w).sum(axis=0), 0.0)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _transformed(x: list[np.ndarray], y: list[np.ndarray], theta: Theta, anchor: tuple[float, ...], anchor_value: float) -> tuple[list[np.ndarray], float]:
    """(latent values of every block, sum of their log f + y**2 / 2 - log b), all blocks of a batch in one call."""
    whole_x = np.concatenate([*x, np.zeros(0)]).reshape(-1, len(theta.ranges))
    latent, log_f, log_b = transform(whole_x, np.concatenate([*y, np.zeros(0)]), theta.extremes, anchor, anchor_value)
    return np.split(latent, np.cumsum([len(v) for v in y])[:-1]) if y else [], float(log_f.sum() + 0.5 * (latent * latent).sum() - log_b.sum())


def block_sums(table: DataFrame, theta: Theta, kernel_type: str, dtype: str = "double", anchor: Sequence[float] = (), anchor_value: float = 0.0) -> DataFrame:
    """logdet, quad, n, failed, extra: one row for each Arrow batch of blocks (partial sums).

    With extremes parameters in theta, observations are transformed first; extra then holds the members' sums of
    log f + y**2 / 2 - log b, each member once.
    """

    def run(batches):
        for batch in batches:
            sums = np.zeros(5)
            all_px, all_py, all_nx, all_ny = (_arrays(batch.column(k)) for k in range(1, 5))
            if theta.extremes:
                all_py, sums[4] = _transformed(all_px, all_py, theta, tuple(anchor), anchor_value)
                all_ny, _ = _transformed(all_nx, all_ny, theta, tuple(anchor), anchor_value)
            logdet, quad, failed = block_values(all_px, all_py, all_nx, all_ny, theta, kernel_type, dtype)
            sums[:4] = logdet, quad, sum(len(py) for py in all_py), failed
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], names=["logdet", "quad", "n", "failed", "extra"])

    return table.select("cid", "px", "py", "nx", "ny").mapInArrow(run, "logdet double, quad double, n double, failed double, extra double")


def block_loglik(table: DataFrame, theta: Theta, kernel_type: str, dtype: str = "double", anchor: Sequence[float] = (), anchor_value: float = 0.0) -> DataFrame:
    """One row: n, logdet, quad, loglik, loglik_full, failed (blocks whose covariance is not positive definite).

    The extremes terms complete the constant, so that with them both values are the same exact log-density.
    """
    sums = block_sums(table, theta, kernel_type, dtype, anchor, anchor_value).agg(*[F.sum(c).alias(c) for c in ("n", "logdet", "quad", "failed", "extra")])
    value = F.when(F.col("failed") > 0, F.lit(float("-inf"))).otherwise(-0.5 * (F.col("logdet") + F.col("quad")) + F.col("extra"))
    full = value if theta.extremes else value - F.col("n") * (LOG_2PI / 2)
    return sums.select(F.col("n").cast("bigint").alias("n"), "logdet", "quad", value.alias("loglik"), full.alias("loglik_full"), F.col("failed").cast("bigint").alias("failed"))


def block_predictions(table: DataFrame, theta: Theta, kernel_type: str, anchor: Sequence[float] = (), anchor_value: float = 0.0) -> DataFrame:
    """cid, place, obs, mean, var of every member given its block's neighbours; under the extremes model all are latent values."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            all_px, all_py, all_nx, all_ny = (_arrays(batch.column(k)) for k in range(1, 5))
            if theta.extremes:
                all_py, _ = _transformed(all_px, all_py, theta, tuple(anchor), anchor_value)
                all_ny, _ = _transformed(all_nx, all_ny, theta, tuple(anchor), anchor_value)
            for cid, px, py, nx, ny in zip(batch.column(0).to_pylist(), all_px, all_py, all_nx, all_ny, strict=True):
                mean, var = member_predictions(px, nx, ny, theta, kernel_type) or ([None] * len(py), [None] * len(py))
                for column, values in zip(out, ([cid] * len(py), range(len(py)), py, mean, var), strict=True):
                    column.extend(values)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["cid", "place", "obs", "mean", "var"])

    return table.select("cid", "px", "py", "nx", "ny").mapInArrow(run, "cid bigint, place bigint, obs double, mean double, var double")
