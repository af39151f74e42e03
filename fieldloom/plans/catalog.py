"""All registered queries of the point-analytics engine, each beside DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import array_squared_distance, coordinates, distance_threshold, md5_order, squared_distance
from ..functions.kernels import kernel
from ..operators import blocks, estimation, extremes, flops, likelihood, neighbors, precision, prediction
from ..operators.regions import kept
from ..sources import points as src
from ..sources import runlog
from . import oracle as sql
from .config import Options, Theta

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
K = 40
M = 5
SCALE2 = (0.5, 2.0)
THETA = Theta(1.0, 0.01, (0.4, 0.4))
POWEXP = Theta(1.0, 0.01, (0.4, 0.4), smoothness=1.5)
SCE = {"lambda_a": 0.5, "kappa_a": 1.2, "beta": 0.3, "mu": 0.1, "tau": 0.9, "delta1": 0.6}
ANCHOR, ANCHOR_VALUE = (0.5, 0.5), 1.5
SPLIT = 10


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that sums in another order print alike."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def rounded_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates rounded to 8 digits; obs has been rounded to 9 already, and halves of a rounded number go either way."""
    return df.withColumns({c: F.round(c, 8) for c in coordinates(df)})


def parts(spark: SparkSession, d: str) -> DataFrame:
    return src.part_points(spark, d)


def assigned(points: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    centers = blocks.sampled_centers(points, k, SEED)
    return blocks.nearest_center(points, centers), centers


def ordered(points: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(points with cid and ord, blocks with centroid and ord); the scaled coordinates are rounded so that means agree in any order of summation."""
    near, _ = assigned(points, k)
    means = blocks.centroids(near)
    means = means.withColumns({c: F.round(c, 9) for c in means.columns if c.startswith("c") and c != "cid"})
    order = blocks.ordered_blocks(means, SEED)
    return neighbors.with_order(near, order), order


def classic(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    near, centers = blocks.classic_blocks(points)
    order = blocks.ordered_blocks(centers, SEED)
    return neighbors.with_order(near, order), order


def classic_neighbours(points: DataFrame, m: int) -> DataFrame:
    near, order = classic(points)
    return neighbors.nearest_earlier(order, near, m)


def scan_points(spark: SparkSession, d: str) -> DataFrame:
    """Parts as comma-separated lines with one column too many, parsed as points."""
    lines = src.table(spark, d, "part").select("p_partkey", F.concat_ws(",", (F.col("p_size") / 50.0).cast("string"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), "p_brand").alias("value"))
    return src.parse_csv_lines(lines, 2).select(F.col("p_partkey").cast("bigint").alias("point_id"), "x1", "x2", "obs")


def minmax_zscore(spark: SparkSession, d: str) -> DataFrame:
    p = src.table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("point_id"), F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("obs"))
    unit = blocks.to_unit(p, {"x1": (1.0, 50.0)})
    moments = p.agg(F.avg("obs").alias("m"), F.stddev_pop("obs").alias("s"))
    return rounded(unit.crossJoin(F.broadcast(moments)).select("point_id", "x1", ((F.col("obs") - F.col("m")) / F.col("s")).alias("obs")), 7)


def lloyd(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return rounded(blocks.lloyd_step(p, blocks.sampled_centers(p, K, SEED)))


def nearest_center_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings and their nearest among 16 sampled ones; the centers travel as one array."""
    p = src.embed_points(spark, d)
    chosen = p.select(md5_order(F.col("point_id"), SEED).alias("key"), "point_id", "coords").orderBy("key", "point_id").limit(16)
    centers = chosen.agg(F.sort_array(F.collect_list(F.struct("key", "point_id", "coords"))).alias("centers"))
    best = F.array_min(F.transform("centers", lambda c, i: F.struct(array_squared_distance(F.col("coords"), c["coords"]).alias("d2"), i.cast("bigint").alias("cid"))))
    return p.crossJoin(F.broadcast(centers)).select("point_id", best.alias("b")).select("point_id", F.col("b.cid").alias("cid"), F.round("b.d2", 8).alias("d2"))


def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    e = src.embed_points(spark, d)
    a, b = e.select(F.col("point_id").alias("a"), F.col("coords").alias("ca")), e.select(F.col("point_id").alias("b"), F.col("coords").alias("cb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(F.sqrt(array_squared_distance(F.col("ca"), F.col("cb"))), 8).alias("dist"))


def threshold_row(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    one = distance_threshold(SCALE2, 1, M, 2.0)  # in proportion to n ** (-1 / relevant coordinates)
    return src.table(spark, d, "part").agg(F.round(F.lit(one) / n, 8).alias("threshold"))


def candidate_range(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    _, train = ordered(p.where(F.col("point_id") % SPLIT != 0))
    _, test = ordered(p.where(F.col("point_id") % SPLIT == 0), 10)
    return neighbors.candidate_range_join(train, test, 0.25)


def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    _, order = ordered(parts(spark, d), 80)
    return neighbors.candidate_order_join(order, 0.5)


def nn_earlier(spark: SparkSession, d: str) -> DataFrame:
    near, order = ordered(parts(spark, d))
    return neighbors.nearest_earlier(order, near, M).select("dest", "rank", "point_id", F.round("d2", 8).alias("d2"))


def nn_fill(spark: SparkSession, d: str) -> DataFrame:
    """A tight radius (also for early blocks, by testing blocks against all) leaves blocks short; candidates fill them."""
    near, order = ordered(parts(spark, d))
    chosen = neighbors.nearest_earlier(order, near, 60).where(F.col("d2") < 0.01)
    return neighbors.filled(chosen, neighbors.candidate_order_join(order, 0.5), order, near, 60).select("dest", "rank", "point_id", F.round("d2", 8).alias("d2"))


def nn_test(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    train, _ = ordered(p.where(F.col("point_id") % SPLIT != 0))
    _, test = ordered(p.where(F.col("point_id") % SPLIT == 0), 10)
    return neighbors.nearest_earlier(test, train, M, is_test=True).select("dest", "rank", "point_id", F.round("d2", 8).alias("d2"))


def kernel_query(name: str) -> Query:
    theta = POWEXP if name == "powexp" else THETA

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = parts(spark, d)
        d2 = squared_distance([F.col("x1"), F.col("x2")], [F.lit(0.5), F.lit(0.5)], likelihood.inverse_squares(theta.ranges))
        return p.select("point_id", F.round(kernel(name).column(theta.variance, d2, theta.smoothness), 10).alias("cov"))

    return run


def cov_long(spark: SparkSession, d: str) -> DataFrame:
    """The covariance matrix of every block's members."""
    near, _ = assigned(parts(spark, d))
    return likelihood.covariance_long(near, THETA, "matern32", digits=9)


def gflop_count(spark: SparkSession, d: str) -> DataFrame:
    near, order = ordered(parts(spark, d))
    have = neighbors.nearest_earlier(order, near, M).groupBy("dest").agg(F.count(F.lit(1)).alias("m"))
    sizes = order.join(have, F.col("cid") == F.col("dest"), "left").select("n", F.coalesce("m", F.lit(0)).alias("m"))
    return flops.gflops(sizes, 2).select(F.round("gflops", 9).alias("gflops"))


def block_members(spark: SparkSession, d: str) -> DataFrame:
    near, order = ordered(parts(spark, d))
    rows = blocks.block_rows(near, order)
    return rows.select("cid", "ord", F.size("pts").cast("bigint").alias("n"), F.aggregate("pts", F.lit(0).cast("bigint"), lambda s, p: s + p["point_id"]).alias("id_sum"), F.element_at("pts", 1)["point_id"].alias("first_id"))


def gp_loglik(m: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = kept(parts(spark, d))
        near = classic_neighbours(p, m)
        conditional = (likelihood.conditional_one if m == 1 else likelihood.conditional_two)(p, near, THETA, "matern32")
        return rounded(likelihood.loglik_of(conditional), 4)

    return run


def sum_terms(spark: SparkSession, d: str) -> DataFrame:
    """Squares and log-determinant of one-neighbour blocks, summed by hundreds of points and in all."""
    p = kept(parts(spark, d))
    c = likelihood.conditional_one(p, classic_neighbours(p, 1), THETA, "matern32")
    e = F.col("obs") - F.col("mean")
    by_block = c.groupBy(F.floor(F.col("point_id") / 100).cast("bigint").alias("grp")).agg(F.sum(e * e / F.col("var")).alias("quad"), F.sum(F.log("var")).alias("logdet"))
    return rounded(by_block, 6)


def classic_block_loglik(m: int) -> Query:
    """The block engine (matrices, factors, solves) on blocks of one point, whose value has a closed form."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = kept(parts(spark, d))
        near, _ = classic(p)
        found = likelihood.block_loglik(likelihood.block_table(near, classic_neighbours(p, m)), THETA, "matern32")
        return rounded(found.select("n", "logdet", "quad", "loglik"), 4)

    return run


def sce_block_loglik(spark: SparkSession, d: str) -> DataFrame:
    """The same under the extremes model, whose transform the engine makes itself."""
    near, order = classic(smooth(spark, d))
    ranked = neighbors.nearest_earlier(order, near, 1)
    theta = Theta(THETA.variance, THETA.nugget, THETA.ranges, extremes=SCE)
    found = likelihood.block_loglik(likelihood.block_table(near, ranked), theta, "matern32", anchor=ANCHOR, anchor_value=ANCHOR_VALUE)
    return found.select("n", F.round("loglik", 3).alias("loglik"))


def block_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the block engine's predictions on blocks of one point with one neighbour."""
    p = smooth(spark, d)
    train, _ = classic(p.where(F.col("point_id") % SPLIT != 0))
    test, order = classic(p.where(F.col("point_id") % SPLIT == 0))
    table = likelihood.block_table(test, neighbors.nearest_earlier(order, train, 1, is_test=True))
    return rounded(prediction.metrics(likelihood.block_predictions(table, THETA, "matern32")), 6)


def block_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The block engine on blocks of two members and no neighbour: pairs of parts 2k and 2k + 1."""
    p = parts(spark, d).withColumn("cid", F.floor(F.col("point_id") / 2).cast("bigint"))
    nothing = p.select(F.col("cid").alias("dest"), F.lit(1).cast("bigint").alias("rank"), "obs", "x1", "x2").where(F.lit(False))
    found = likelihood.block_loglik(likelihood.block_table(p, nothing), THETA, "matern32")
    return rounded(found.select("n", "logdet", "quad", "loglik"), 4)


def block_likelihood(spark: SparkSession, d: str) -> DataFrame:
    near, order = ordered(kept(parts(spark, d)))
    table = likelihood.block_table(near, neighbors.nearest_earlier(order, near, 20))
    return rounded(likelihood.block_loglik(table, THETA, "matern32"), 4)


def smooth(spark: SparkSession, d: str) -> DataFrame:
    return src.smooth_points(src.ids_of(spark, d, "part", "p_partkey"))


def sce_points(spark: SparkSession, d: str) -> DataFrame:
    return extremes.transformed(smooth(spark, d), SCE, ANCHOR, ANCHOR_VALUE)


def sce_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian log-likelihood of the latent values, one neighbour each, with the transform's terms counted once."""
    t = kept(sce_points(spark, d))
    latent_points = t.select("point_id", "x1", "x2", F.round("y", 9).alias("obs"))
    gp = likelihood.loglik_of(likelihood.conditional_one(latent_points, classic_neighbours(latent_points, 1), THETA, "matern32"))
    total = F.col("loglik") + F.col("sum_log_f") + F.col("half_sum_y2") - F.col("sum_log_b")
    return gp.crossJoin(extremes.jacobian_sums(t)).select("n", F.round("loglik", 3).alias("loglik_latent"), F.round(total, 3).alias("loglik"))


def predicted_one(spark: SparkSession, d: str) -> DataFrame:
    p = smooth(spark, d)
    train, test = p.where(F.col("point_id") % SPLIT != 0), p.where(F.col("point_id") % SPLIT == 0)
    near, _ = classic(train)
    _, order = classic(test)
    found = neighbors.nearest_earlier(order, near, 1, is_test=True)
    return likelihood.conditional_one(test, found, THETA, "matern32")


def mc_interval(spark: SparkSession, d: str) -> DataFrame:
    drawn = prediction.draws(predicted_one(spark, d), 50, SEED)
    return rounded(prediction.sample_moments(drawn).select("point_id", "mean", "var"), 6)


def block_prediction(spark: SparkSession, d: str) -> DataFrame:
    p = smooth(spark, d)
    train, _ = ordered(p.where(F.col("point_id") % SPLIT != 0))
    test, order = ordered(p.where(F.col("point_id") % SPLIT == 0), 10)
    table = likelihood.block_table(test, neighbors.nearest_earlier(order, train, 30, is_test=True))
    return rounded(prediction.metrics(likelihood.block_predictions(table, THETA, "matern32")), 6)


def smooth_options(points: DataFrame, **more) -> Options:
    """Blocks of about fifty points."""
    return Options(dim=2, num_total_blocks=max(8, points.count() // 50), m=20, m_test=20, num_total_blocks_test=10, seed=SEED, distance_scale=(1.0, 1.0), distance_scale_init=(0.4, 0.4), kernel_type="matern32", **more)


def fit_smooth(spark: SparkSession, d: str) -> DataFrame:
    """The search over all points, to its tolerances."""
    points = smooth(spark, d)
    found, prepared = estimation.fit(points, smooth_options(points))
    prepared.release()
    return estimation.trace_frame(spark, found)


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """The log row of a prediction run over all points, neighbours within a radius."""
    from .run import run

    p = smooth(spark, d)
    train, test = p.where(F.col("point_id") % SPLIT != 0), p.where(F.col("point_id") % SPLIT == 0)
    return run(spark, smooth_options(p, mode="prediction", nn_multiplier=4, num_simulations=100), train, test).log


def trial_values(spark: SparkSession, d: str) -> DataFrame:
    t = src.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return rounded(precision.trial_stats(t, ["kind"], "v"), 6)


def displacements(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the linear parts and their exclusive prefix sums."""
    p = blocks.linear_part(src.event_points(spark, d), (1.0, 0.5), 16)
    counts = p.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("part", "n", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))


def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of two radii united without repeats."""
    _, order = ordered(parts(spark, d), 80)
    return neighbors.candidate_order_join(order, 0.2).unionByName(neighbors.candidate_order_join(order, 0.6)).dropDuplicates(["src", "dest"])


def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    near, order = ordered(parts(spark, d), 80)
    return neighbors.candidate_points(neighbors.candidate_order_join(order, 0.5), near)


def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    near, _ = assigned(parts(spark, d))
    return blocks.weighted_draw(near, "d2", SEED).select("point_id", F.round("d2", 8).alias("d2"))


def queries() -> dict[str, Query]:
    return {
        "scan_points": scan_points,
        "part_points": lambda s, d: rounded_coordinates(parts(s, d)),
        "event_points": lambda s, d: rounded(src.event_points(s, d)),
        "lineitem_points": lambda s, d: rounded(src.lineitem_points(s, d)),
        "smooth_points": lambda s, d: rounded(smooth(s, d)),
        "synthetic_points": lambda s, d: src.uniform_points(s, 1000, 3, SEED),
        "disc_split": lambda s, d: rounded(src.disc_points(src.ids_of(s, d, "orders", "o_orderkey"), 10.0), 10),
        "borehole": lambda s, d: rounded(src.borehole_points(src.ids_of(s, d, "orders", "o_orderkey")), 7),
        "limit_rows": lambda s, d: src.first_points(parts(s, d), 100).select("point_id"),
        "scale_coords": lambda s, d: rounded_coordinates(blocks.scaled(parts(s, d), SCALE2)),
        "unscale_coords": lambda s, d: rounded_coordinates(blocks.unscaled(blocks.scaled(parts(s, d), SCALE2), SCALE2)),
        "minmax_zscore": minmax_zscore,
        "cast_float": lambda s, d: blocks.narrowed(src.event_points(s, d)).select("point_id", F.col("x2").cast("double").alias("x2")),
        "linear_partition": lambda s, d: blocks.linear_part(src.event_points(s, d), (1.0, 0.5), 16).select("point_id", F.col("part").cast("bigint").alias("part")),
        "displacements": displacements,
        "sample_centers": lambda s, d: rounded(blocks.sampled_centers(parts(s, d), K, SEED)),
        "nearest_center": lambda s, d: assigned(parts(s, d))[0].select("point_id", "cid", F.round("d2", 8).alias("d2")),
        "nearest_center_embeddings": nearest_center_embeddings,
        "block_sizes": lambda s, d: blocks.block_sizes(assigned(parts(s, d))[0]),
        "centroids": lambda s, d: rounded(blocks.centroids(assigned(parts(s, d))[0])),
        "block_order": lambda s, d: ordered(parts(s, d))[1].select("cid", "ord"),
        "classic_blocks": lambda s, d: classic(parts(s, d))[1].select("cid", "ord"),
        "block_rows": block_members,
        "lloyd_step": lloyd,
        "kmeans_pp": lambda s, d: rounded(blocks.kmeans_pp(smooth(s, d), 6, 3, SEED)),
        "weighted_draw": weighted_choice,
        "pair_distance": pair_distance,
        "dist_threshold": threshold_row,
        "candidate_range_join": candidate_range,
        "candidate_order_join": candidate_order,
        "candidate_totals": candidate_totals,
        "union_dedup": union_dedup,
        "nn_earlier_topm": nn_earlier,
        "nn_fill": nn_fill,
        "nn_test_topm": nn_test,
        **{f"kernel_{k}": kernel_query(k) for k in ("matern12", "matern32", "matern52", "matern72", "powexp", "exponential")},
        "cov_long": cov_long,
        "gflops": gflop_count,
        "gp_loglik_m1": gp_loglik(1),
        "gp_loglik_m2": gp_loglik(2),
        "sum_terms": sum_terms,
        "block_loglik": block_likelihood,
        "block_loglik_m1": classic_block_loglik(1),
        "block_loglik_m2": classic_block_loglik(2),
        "block_loglik_pairs": block_pairs,
        "sce_block_loglik_m1": sce_block_loglik,
        "block_metrics_m1": block_metrics,
        "sce_terms": lambda s, d: rounded(extremes.terms(smooth(s, d), SCE, ANCHOR, ANCHOR_VALUE).select("point_id", "delta", "a", "b", "z")),
        "dl_pdf": lambda s, d: rounded(sce_points(s, d).select("point_id", F.exp("log_f").alias("f"))),
        "dl_cdf": lambda s, d: rounded(sce_points(s, d).select("point_id", "u")),
        "latent": lambda s, d: rounded(sce_points(s, d).select("point_id", "y"), 6),
        "sce_loglik_m1": sce_loglik,
        "predict_m1": lambda s, d: rounded(predicted_one(s, d).select("point_id", "mean", "var")),
        "pred_metrics": lambda s, d: rounded(prediction.metrics(predicted_one(s, d)), 6),
        "mc_interval": mc_interval,
        "block_prediction": block_prediction,
        "fit": fit_smooth,
        "run_log": run_log,
        "precision_grid": lambda s, d: precision.precision_grid(s, 10),
        "trial_stats": trial_values,
    }


def oracle_sql() -> dict[str, str]:
    return sql.all_sql()
