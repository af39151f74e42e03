"""Invariants of the point engine."""

from __future__ import annotations

import math
import statistics
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry, kernels, special
from fieldloom.operators import blocks, estimation, extremes, flops, likelihood, neighbors, precision, prediction, regions
from fieldloom.plans.config import Options, Theta, bounds, initial_theta, unpack
from fieldloom.sources import points as src
from fieldloom.sources import runlog

THETA = Theta(1.3, 0.05, (0.4, 0.7))


@pytest.fixture(scope="module")
def cloud(spark):
    return src.uniform_points(spark, 120, 2, 3).persist()


def arrays(df):
    rows = df.orderBy("point_id").toPandas()
    return rows["point_id"].to_numpy(), rows[["x1", "x2"]].to_numpy(), rows["obs"].to_numpy()


def dense_loglik(x, y, theta, kind="matern32"):
    cov = likelihood.joint_covariance(x, theta, kind)
    factor = np.linalg.cholesky(cov)
    z = np.linalg.solve(factor, y)
    return -0.5 * (2 * np.log(np.diag(factor)).sum() + z @ z)


def ordered(points, k, seed=1):
    near = blocks.nearest_center(points, blocks.sampled_centers(points, k, seed))
    order = blocks.ordered_blocks(blocks.centroids(near), seed)
    return neighbors.with_order(near, order), order


def test_all_neighbours_give_the_exact_likelihood(spark, cloud):
    near, order = ordered(cloud, 10)
    table = likelihood.block_table(near, neighbors.nearest_earlier(order, near, 1000))
    got = likelihood.block_loglik(table, THETA, "matern32").first()
    _, x, y = arrays(cloud)
    assert got["loglik"] == pytest.approx(dense_loglik(x, y, THETA), rel=1e-9)
    assert got["loglik_full"] == pytest.approx(got["loglik"] - 60 * math.log(2 * math.pi))
    assert got["failed"] == 0 and got["n"] == 120


def test_closed_forms_agree_with_cholesky(spark, cloud):
    near, centers = blocks.classic_blocks(cloud)
    order = blocks.ordered_blocks(centers, 5)
    near = neighbors.with_order(near, order)
    for m, form in ((1, likelihood.conditional_one), (2, likelihood.conditional_two)):
        found = neighbors.nearest_earlier(order, near, m).persist()
        closed = likelihood.loglik_of(form(cloud, found, THETA, "matern32")).first()["loglik"]
        general = likelihood.block_loglik(likelihood.block_table(near, found), THETA, "matern32").first()["loglik"]
        assert closed == pytest.approx(general, rel=1e-9)


def test_result_does_not_depend_on_partitions(spark, cloud):
    values = []
    for n in (1, 3, 7):
        near, order = ordered(cloud.repartition(n), 12)
        values.append(likelihood.block_loglik(likelihood.block_table(near, neighbors.nearest_earlier(order, near, 9)), THETA, "matern52").first()["loglik"])
    assert values[0] == pytest.approx(values[1], rel=1e-10) == pytest.approx(values[2], rel=1e-10)


def test_joins_and_matrices_agree(spark, cloud):
    centers = blocks.sampled_centers(cloud, 9, 2)
    a = sorted(map(tuple, blocks.nearest_center(cloud, centers).select("point_id", "cid", "d2").collect()))
    b = sorted(map(tuple, blocks.nearest_center_by_join(cloud, centers).select("point_id", "cid", "d2").collect()))
    assert a == b == sorted(map(tuple, blocks.nearest_center(cloud, centers, limit=3).select("point_id", "cid", "d2").collect()))
    near, order = ordered(cloud, 9)
    for threshold, test in ((None, False), (0.3, False), (0.3, True)):
        one = neighbors.nearest_earlier(order, near, 4, threshold, test).select("dest", "rank", "point_id")
        two = neighbors.nearest_earlier_by_join(order, near, 4, threshold, test).select("dest", "rank", "point_id")
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_ties_go_to_the_lowest_number(spark):
    p = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, 0.5, 0.0, 1.0)], "point_id long, x1 double, x2 double, obs double")
    c = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "cid long, c1 double, c2 double")
    assert {r["cid"] for r in blocks.nearest_center(p, c).collect()} == {0}


def test_empty_and_single_points(spark):
    empty = spark.createDataFrame([], "point_id long, x1 double, x2 double, obs double")
    c = spark.createDataFrame([(0, 0.0, 0.0)], "cid long, c1 double, c2 double")
    assert blocks.nearest_center(empty, c).count() == 0
    assert blocks.centroids(blocks.nearest_center(empty, c), c).collect()[0]["n"] == 0
    one = spark.createDataFrame([(7, 0.2, 0.3, 1.5)], "point_id long, x1 double, x2 double, obs double")
    near, order = ordered(one, 1)
    got = likelihood.block_loglik(likelihood.block_table(near, neighbors.nearest_earlier(order, near, 3)), THETA, "matern12").first()
    k0 = THETA.variance + THETA.nugget
    assert got["loglik"] == pytest.approx(-0.5 * (math.log(k0) + 1.5**2 / k0))


def test_singular_blocks_are_reported(spark):
    twins = spark.createDataFrame([(1, 0.5, 0.5, 0.0), (2, 0.5, 0.5, 1.0)], "point_id long, x1 double, x2 double, obs double")
    near, order = ordered(twins, 1)
    got = likelihood.block_loglik(likelihood.block_table(near, neighbors.nearest_earlier(order, near, 3)), Theta(1.0, -1e-3, (0.4, 0.4)), "matern32").first()
    assert got["failed"] == 1 and got["loglik"] == float("-inf")


@pytest.mark.parametrize("name", sorted(kernels.KERNELS))
def test_kernels_agree_and_are_positive(spark, name):
    k = kernels.kernel(name)
    d2 = np.array([0.0, 0.01, 0.5, 4.0])
    column = [r[0] for r in spark.createDataFrame([(float(v),) for v in d2], "d double").select(k.column(1.7, F.col("d"), 1.2)).collect()]
    assert column == pytest.approx(k.array(1.7, d2, 1.2).tolist())
    assert column[0] == pytest.approx(1.7) and sorted(column, reverse=True) == pytest.approx(column)


def test_kernel_values_by_hand():
    r = 0.3
    d2 = np.array([r * r])
    assert kernels.MATERN12.array(2.0, d2, 0)[0] == pytest.approx(2 * math.exp(-r))
    s = math.sqrt(5) * r
    assert kernels.MATERN52.array(2.0, d2, 0)[0] == pytest.approx(2 * (1 + s + s * s / 3) * math.exp(-s))
    for nu in (0.5, 1.5, 2.5):
        other = kernels.matern_general(1.0, np.array([0.04, 0.5]), nu + 1e-7)
        assert other == pytest.approx(kernels.matern_general(1.0, np.array([0.04, 0.5]), nu), rel=1e-4)
    with pytest.raises(ValueError):
        kernels.kernel("cubic")


def test_special_functions():
    x = np.array([0.0, 0.1, 1.0, 5.0, 150.0, 250.0, np.inf])
    assert special.incomplete_gamma(0.5, x) == pytest.approx([math.erf(math.sqrt(v)) for v in x])
    assert special.incomplete_gamma(2.0, np.array([3.0]))[0] == pytest.approx(1 - 4 * math.exp(-3))
    u = np.array([1e-12, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9])
    assert special.normal_quantile(u) == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in u], rel=1e-7, abs=1e-12)


def test_latent_values_are_normal(spark):
    """Latent values of delta-Laplace draws with exponent 2 (h = 0) are standard normal."""
    rng = np.random.default_rng(1)
    z = rng.normal(0, 0.9 / math.sqrt(2), 4000) + 0.1
    p = {"lambda_a": 0.5, "kappa_a": 1.2, "beta": 0.3, "mu": 0.1, "tau": 0.9, "delta1": 0.6}
    rows = spark.createDataFrame([(i, 0.5, 0.5, float(v)) for i, v in enumerate(z)], "point_id long, x1 double, x2 double, obs double")
    y = np.array([r["y"] for r in extremes.transformed(rows, p, (0.5, 0.5), 0.0).select("y").collect()])
    assert abs(y.mean()) < 0.06 and abs(y.std() - 1) < 0.04
    far = spark.createDataFrame([(1, 0.5, 0.5, 1e6)], "point_id long, x1 double, x2 double, obs double")
    assert extremes.transformed(far, p, (0.5, 0.5), 0.0).first()["u"] == 1.0
    with pytest.raises(ValueError):
        extremes.terms(rows, p, (0.5, 0.5), -1.0)


def test_threshold_values():
    assert geometry.distance_threshold((1.0, 1.0), 100, 5, 1.0) == pytest.approx(1.2 * (5 / 100) / 2)
    assert geometry.distance_threshold((0.5, 0.5, 0.5), 1000, 8, 1.0) == pytest.approx(1.2 * (8 / 125 / (4 / 3 * math.pi)) ** (1 / 3))
    assert geometry.unit_ball_volume(2) == pytest.approx(math.pi)


def test_csv_lines(spark, tmp_path):
    path = tmp_path / "points.csv"
    path.write_text("0.1,0.2,3\n0.3,0.4,5,99\n0.5,0.6\nx,0.1,2\n")
    got = src.read_csv_points(spark, str(path), 2, "DROPMALFORMED").orderBy("point_id").collect()
    assert [(r["point_id"], r["x1"], r["obs"]) for r in got] == [(0, 0.1, 3.0), (1, 0.3, 5.0)]
    with pytest.raises(Exception, match="malformed"):
        src.read_csv_points(spark, str(path), 2).collect()


def test_log_sinks(spark, tmp_path):
    for _ in range(2):
        runlog.append_log(runlog.log_row(spark, {"m": 5, "mspe": 0.25}), str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    runlog.append_theta(spark, (1.0, 0.5), str(tmp_path / "theta"))
    assert spark.read.text(str(tmp_path / "theta")).first()[0] == "1.0,0.5"
    assert "m_5" in runlog.run_name(1, 2, 5, 0, True)
    with pytest.raises(ValueError):
        runlog.log_row(spark, {"nothing": 1})


def test_options():
    o = Options(dim=3).checked()
    assert initial_theta(o) == (1.0, 1e-5, 1.0, 1.0, 1.0)
    low, high = bounds(o, initial_theta(o))
    assert (low[0], high[0], low[1], high[1]) == (0.01, 3.0, 0.0, 0.1)
    p = Options(dim=2, kernel_type="powexp", model_type="sce").checked()
    assert unpack(p, initial_theta(p)).extremes["tau"] == 0.1
    for bad in ({"mode": "x"}, {"partition": "x"}, {"kernel_type": "x"}, {"precision": "x"}, {"model_type": "sce", "dim": 8}, {"dim": 2, "distance_scale": (1.0,)}):
        with pytest.raises(ValueError):
            Options(**bad).checked()


def test_search_finds_a_bounded_maximum():
    got = estimation.maximise(lambda t: -((t[0] - 0.3) ** 2) - 4 * (t[1] - 2.0) ** 2 - abs(t[2]), (1.0, 1.0, 1.0), (0.0, 0.0, 0.1), (3.0, 1.5, 2.0), maxeval=2000)
    assert got.x == pytest.approx((0.3, 1.5, 0.1), abs=1e-3)


def test_fit_improves_the_likelihood(spark):
    p = src.smooth_points(spark.range(150).select(F.col("id").alias("point_id")))
    found, prepared = estimation.fit(p, Options(dim=2, num_total_blocks=5, m=10, maxeval=10, distance_scale_init=(0.4, 0.4)))
    assert found.evaluations == 10 and found.value >= found.trace[0][2]
    assert set(prepared.seconds) == {"RAC_partitioning", "centers_of_gravity_calculation", "reorder_centers", "create_block_info", "nn_searching", "gpu_copy", "computation"}


def test_kmeans_lowers_distances(spark, cloud):
    start = blocks.sampled_centers(cloud, 6, 4)
    better = blocks.kmeans_pp(cloud, 6, 4, 4)

    def cost(c):
        return blocks.nearest_center(cloud, c).agg(F.sum("d2")).first()[0]

    assert cost(better) < cost(start)
    assert blocks.finer_partition(cloud, 70, "random", 1, 0)[1].count() == 120


def test_fill_reaches_m(spark, cloud):
    near, order = ordered(cloud, 10)
    few = neighbors.nearest_earlier(order, near, 20).where("rank <= 2")
    full = neighbors.filled(few, neighbors.candidate_order_join(order, 10.0), order, near, 20)
    have = {r["dest"]: r["n"] for r in full.groupBy("dest").agg(F.count(F.lit(1)).alias("n")).collect()}
    earlier = {r["cid"]: r["k"] for r in order.alias("a").join(near.alias("b"), F.col("b.ord") < F.col("a.ord")).groupBy("a.cid").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert all(n == min(20, earlier[c]) for c, n in have.items())


def test_metrics_and_draws(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.1, 0.04), (2, 0.0, 0.5, 0.01), (3, 2.0, 2.0, 0.0)], "point_id long, obs double, mean double, var double")
    got = prediction.metrics(rows).first()
    assert got["mspe"] == pytest.approx((0.01 + 0.25) / 3)
    assert got["rmspe"] == pytest.approx(math.sqrt(100 / 3))
    assert got["coverage"] == pytest.approx(2 / 3)
    m = prediction.sample_moments(prediction.draws(rows, 400, 1)).where("point_id = 1").first()
    assert m["mean"] == pytest.approx(1.1, abs=0.05) and m["var"] == pytest.approx(0.04, rel=0.25)


def test_precision_pieces():
    inner, ring = precision.disc(10, 300, 1)
    assert np.hypot(*inner.T).max() <= 0.1 / math.sqrt(3) < np.hypot(*ring.T).min()
    y = precision.sample_prior(ring[:40], 1.5, 2)
    assert y.shape == (2, 40)
    mean, cov = precision.conditional(ring[:40], y[0], inner[:5], 1.5, np.float64)
    assert np.linalg.eigvalsh(cov).min() > -1e-6
    assert math.isfinite(precision.conditional_loglik(mean, mean, cov))


def test_operation_count(spark):
    got = flops.gflops(spark.createDataFrame([(1, 0)], "n long, m long"), 2).first()[0] * 1e9
    assert got == pytest.approx(17 + 1 + 0 + 1 + 2 + 2 + 8)


def test_extremes_likelihood_in_blocks(spark):
    """The transform inside the kernel agrees with the transform as columns, terms counted once."""
    p = {"lambda_a": 0.5, "kappa_a": 1.2, "beta": 0.3, "mu": 0.1, "tau": 0.9, "delta1": 0.6}
    points = src.smooth_points(spark.range(60).select(F.col("id").alias("point_id"))).persist()
    theta = Theta(1.0, 0.01, (0.4, 0.4), extremes=p)
    near, order = ordered(points, 6)
    table = likelihood.block_table(near, neighbors.nearest_earlier(order, near, 5))
    inside = likelihood.block_loglik(table, theta, "matern32", anchor=(0.5, 0.5), anchor_value=1.5).first()["loglik"]
    t = extremes.transformed(points, p, (0.5, 0.5), 1.5).persist()
    near, order = ordered(t.select("point_id", "x1", "x2", F.col("y").alias("obs")), 6)
    table = likelihood.block_table(near, neighbors.nearest_earlier(order, near, 5))
    outside = likelihood.block_loglik(table, Theta(1.0, 0.01, (0.4, 0.4)), "matern32").first()["loglik"]
    s = extremes.jacobian_sums(t).first()
    assert inside == pytest.approx(outside + s["sum_log_f"] + s["half_sum_y2"] - s["sum_log_b"], rel=1e-8)


@pytest.mark.parametrize("model", ["gp", "sce"])
def test_whole_runs(spark, tmp_path, model):
    from fieldloom.__main__ import parsed
    from fieldloom.plans.run import run

    o = parsed(["--dim", "2", "--num_total_points", "120", "--num_total_blocks", "6", "--m", "8", "--mode", "full", "--maxeval", "4", "--num_total_points_test", "20", "--num_total_blocks_test", "3", "--m_test", "6", "--num_simulations", "20", "--model_type", model, "--sce_params", "0.5,1.2,0.3,0.1,0.9,0.6", "--log_append", str(tmp_path)])
    got = run(spark, o)
    assert got.evaluations == 4 and math.isfinite(got.loglik) and got.metrics["n"] == 20 and 0 <= got.metrics["coverage"] <= 1
    assert got.log.first()["iters"] == 4 and len(list(tmp_path.iterdir())) == 2
    with pytest.raises(SystemExit):
        parsed(["--nothing", "1"])


def test_forward_substitution_and_member_predictions():
    from fieldloom.operators import likelihood
    from fieldloom.plans.config import Theta

    rng = np.random.default_rng(4)
    theta = Theta(1.3, 0.02, (0.3, 0.6))
    nx, px, ny, py = rng.random((75, 2)), rng.random((6, 2)), rng.normal(size=75), rng.normal(size=6)
    factor = np.linalg.cholesky(likelihood.joint_covariance(nx, theta, "matern52"))
    for right in (ny, rng.normal(size=(75, 3))):
        assert np.allclose(likelihood.forward(factor, right), np.linalg.solve(factor, right))
    mean, var = likelihood.member_predictions(px.ravel(), nx.ravel(), ny, theta, "matern52")
    for k in range(6):
        _, _, own_mean, own_var, ok = likelihood.block_terms(px[k], py[k : k + 1], nx.ravel(), ny, theta, "matern52")
        assert ok and np.isclose(mean[k], own_mean[0]) and np.isclose(var[k], own_var[0])
    alone = likelihood.member_predictions(px.ravel(), np.zeros(0), np.zeros(0), theta, "matern52")
    assert np.allclose(alone[0], 0) and np.allclose(alone[1], 1.32)


def test_runs_search_within_the_derived_radius(spark):
    """More than 200 blocks, so that the radius cuts; blocks with too few points within it are filled up."""
    from fieldloom.functions.geometry import distance_threshold
    from fieldloom.operators import estimation
    from fieldloom.plans.config import Options

    rng = np.random.default_rng(5)
    cloud = rng.random((900, 2))
    points = spark.createDataFrame([(i, float(x), float(y), float(x + y)) for i, (x, y) in enumerate(cloud)], "point_id long, x1 double, x2 double, obs double")
    o = Options(dim=2, num_total_blocks=300, m=8, nn_multiplier=2, distance_scale=(0.9, 0.9), distance_scale_init=(0.4, 0.4)).checked()
    coarse, finer = estimation.radii(o, 900, 8)
    assert coarse == finer == distance_threshold((0.9, 0.9), 900, 8, 2)
    assert estimation.radii(Options(dim=2).checked(), 900, 8) == (None, None)
    prepared = estimation.prepare(points, o)
    placed = prepared.points.toPandas()
    blocks_ = placed.groupby("cid").agg(ord=("ord", "first"), c1=("x1", "mean"), c2=("x2", "mean")).reset_index()
    sizes = {r["cid"]: len(r["ny"]) for r in prepared.table.select("cid", "ny").collect()}
    values = {r["cid"]: sorted(r["ny"]) for r in prepared.table.select("cid", "ny").collect()}
    seen = Counter()
    for b in blocks_.itertuples():
        earlier = placed[placed.ord < b.ord].copy()
        earlier["d"] = np.hypot(earlier.x1 - b.c1, earlier.x2 - b.c2)
        near = earlier if b.ord <= 200 else earlier[earlier.d < finer]
        near = near.sort_values(["d", "ord", "point_id"]).head(8)
        if 0 < len(near) < 8:
            first = blocks_[(blocks_.ord < b.ord) & ((blocks_.ord < 42) | (np.hypot(blocks_.c1 - b.c1, blocks_.c2 - b.c2) < coarse / 2))].cid
            rest = earlier[earlier.cid.isin(first) & ~earlier.point_id.isin(near.point_id)].sort_values(["ord", "point_id"]).head(8 - len(near))
            near = pd.concat([near, rest])
            seen["filled"] += len(rest) > 0
        assert sizes[b.cid] == len(near)
        assert np.allclose(values[b.cid], sorted(near.obs), atol=1e-9)
        seen["late"] += b.ord > 200
    assert seen["late"] > 50
    prepared.release()


@pytest.mark.parametrize("kind", ["uniform", "copies", "lattice"])
def test_regions_and_joins_agree(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = {"uniform": rng.random((700, 2)), "copies": np.repeat(rng.random((20, 2)), 35, axis=0), "lattice": rng.integers(0, 9, (700, 2)) / 8}[kind]
    p = spark.createDataFrame([(i, *map(float, r), float(i)) for i, r in enumerate(x)], "point_id long, x1 double, x2 double, obs double").persist()
    near, centers = blocks.classic_blocks(p)
    order = blocks.ordered_blocks(centers, 3)
    near = neighbors.with_order(near, order).persist()
    monkeypatch.setattr(regions, "REGION", 60)
    monkeypatch.setattr(regions, "HEAD", 50)
    for m, threshold, test in ((1, None, False), (2, None, False), (7, None, False), (3, 0.1, False), (3, None, True), (5, 0.1, True)):
        one = neighbors.nearest_earlier(order, near, m, threshold, test, limit=1)
        two = neighbors.nearest_earlier_by_join(order, near, m, threshold, test)
        assert sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect()))


def test_many_centers_meet_in_regions(spark, cloud, monkeypatch):
    """A join of all points with all centers would make their product in rows."""
    monkeypatch.setattr(regions, "REGION", 16)
    centers = blocks.sampled_centers(cloud, 40, 2)
    found = blocks.nearest_center(cloud, centers, limit=3)
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blocks.nearest_center_by_join(cloud, centers).collect()))
    near, order = ordered(cloud, 40)
    plan = neighbors.nearest_earlier(order, near, 2, limit=3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_copies_of_a_place_share_a_row_of_the_matrix(monkeypatch):
    """40 places with 10 points each: a matrix of 400 rows is more than the merged block may make."""
    rng = np.random.default_rng(4)
    places = rng.random((40, 2))
    px, nx = np.repeat(places, 10, axis=0)[rng.permutation(400)], np.concatenate([places[:3], places[:2], rng.random((4, 2))])
    py, ny = rng.normal(size=400), rng.normal(size=9)
    logdet, quad, _, _, ok = likelihood.block_terms(px.ravel(), py, nx.ravel(), ny, THETA, "matern32")
    made, covariance = [], likelihood.covariance
    monkeypatch.setattr(likelihood, "covariance", lambda a, b, *more: made.append(len(a)) or covariance(a, b, *more))
    got = likelihood.block_value(px.ravel(), py, nx.ravel(), ny, THETA, "matern32")
    assert made == [47] and ok and got[2]
    assert got[:2] == pytest.approx((logdet, quad), rel=1e-9)


def test_a_batch_is_transformed_at_once(monkeypatch):
    """One call for all blocks of a batch, with or without neighbours, and the values of a call for each block."""
    rng = np.random.default_rng(6)
    theta = Theta(1.0, 0.01, (0.4, 0.4), extremes={"lambda_a": 0.5, "kappa_a": 1.2, "beta": 0.3, "mu": 0.1, "tau": 0.9, "delta1": 0.6})
    x, y = [rng.random(2 * n) for n in (1, 0, 3)], [rng.normal(size=n) for n in (1, 0, 3)]
    plain = [likelihood.transform(a.reshape(-1, 2), b, theta.extremes, (0.5, 0.5), 1.5) for a, b in zip(x, y, strict=True)]
    calls, transform = [], likelihood.transform
    monkeypatch.setattr(likelihood, "transform", lambda *a: calls.append(1) or transform(*a))
    latent, extra = likelihood._transformed(x, y, theta, (0.5, 0.5), 1.5)
    assert len(calls) == 1 and [len(v) for v in latent] == [1, 0, 3]
    assert np.concatenate(latent) == pytest.approx(np.concatenate([p[0] for p in plain]), rel=1e-12)
    assert extra == pytest.approx(sum(f.sum() + 0.5 * (v * v).sum() - b.sum() for v, f, b in plain), rel=1e-12)
    assert likelihood._transformed([], [], theta, (0.5, 0.5), 1.5) == ([], 0.0)


def test_long_covariance_deals_a_block_to_many_tasks(spark):
    """130 points of a block at each of 4 places, two of them nulls and NaN, an id given twice: all pairs, no task with most of them."""
    theta, nan = Theta(1.0, 0.01, (0.4, 0.4)), float("nan")
    places = [(0.0, 0.1), (-0.0, 0.1), (0.7, 0.2), (nan, 0.5), (None, 0.5)]
    points = [(k, 7, *places[k % 5]) for k in range(650)] + [(650, 8, 0.1, 0.1), (3, 7, 0.7, 0.2)]
    assigned = spark.createDataFrame(points, "point_id long, cid long, x1 double, x2 double")
    got = likelihood.covariance_long(assigned, theta, "matern32", digits=9)

    def value(a, b):
        if a[2] is None or b[2] is None:
            return None
        s = math.sqrt(3.0) * math.hypot(a[2] - b[2], a[3] - b[3]) / 0.4
        found = (1.0 + s) * math.exp(-s) + (0.01 if a[0] == b[0] else 0.0)
        return "nan" if math.isnan(found) else round(found, 7)

    def told(v):
        return v if v is None else "nan" if math.isnan(v) else round(v, 7)

    want = Counter((a[1], a[0], b[0], value(a, b)) for a in points for b in points if a[1] == b[1] and a[0] <= b[0])
    assert Counter((r["cid"], r["i"], r["j"], told(r["val"])) for r in got.collect()) == want
    shares = [r["count"] for r in got.where("cid = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 1 and max(shares) < 0.75 * sum(shares)


def test_small_blocks_are_factored_together(monkeypatch):
    """Blocks of many sizes, one of them empty and one without a factor: the sums of the blocks alone, from fewer factors than blocks."""
    rng = np.random.default_rng(12)
    sizes = [(int(n), int(m)) for n, m in zip(rng.integers(0, 90, 60), rng.integers(0, 21, 60), strict=True)] + [(0, 0), (300, 20)]
    px, py = [rng.random(2 * n) for n, _ in sizes], [rng.normal(size=n) for n, _ in sizes]
    nx, ny = [rng.random(2 * m) for _, m in sizes], [rng.normal(size=m) for _, m in sizes]
    for kernel_type in ("matern12", "matern52", "exponential"):
        alone = np.array([likelihood.block_value(*v, THETA, kernel_type) for v in zip(px, py, nx, ny, strict=True)])
        calls, plain = [], np.linalg.cholesky
        monkeypatch.setattr(np.linalg, "cholesky", lambda a, calls=calls, plain=plain: calls.append(1) or plain(a))
        logdet, quad, failed = likelihood.block_values(px, py, nx, ny, THETA, kernel_type)
        monkeypatch.undo()
        assert (logdet, quad, failed) == (pytest.approx(alone[:, 0].sum(), rel=1e-9), pytest.approx(alone[:, 1].sum(), rel=1e-9), 0)
        assert len(calls) < 50
    bad = Theta(1.0, -1e-3, (0.4, 0.4))
    px[3], py[3] = np.zeros(20), np.zeros(10)
    alone = np.array([likelihood.block_value(*v, bad, "matern12") for v in zip(px, py, nx, ny, strict=True)])
    logdet, quad, failed = likelihood.block_values(px, py, nx, ny, bad, "matern12")
    assert failed == len(sizes) - alone[:, 2].sum() > 0
    assert (logdet, quad) == (pytest.approx(alone[:, 0].sum(), rel=1e-9), pytest.approx(alone[:, 1].sum(), rel=1e-9))
    assert likelihood.block_values([], [], [], [], THETA, "matern12") == (0.0, 0.0, 0)
