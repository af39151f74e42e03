"""Scaling, partitioning and blocking of points.

Assignment to the nearest center is a distance matrix between an Arrow batch of points and a bounded number of
centers, which keeps it free of shuffles; squared distances are summed by subtraction, product and sum in
coordinate order, so that ties are decided alike in every engine (lowest center number).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import coordinates, md5_order, md5_uniform

#: Centers that are sent to every task, at most; beyond it points and centers meet in regions of space.
MAX_SHARED_CENTERS = 4096


def scaled(points: DataFrame, scale: Sequence[float]) -> DataFrame:
    xs = coordinates(points)
    return points.withColumns({x: F.col(x) / F.lit(float(s)) for x, s in zip(xs, scale, strict=True)})


def unscaled(points: DataFrame, scale: Sequence[float]) -> DataFrame:
    xs = coordinates(points)
    return points.withColumns({x: F.col(x) * F.lit(float(s)) for x, s in zip(xs, scale, strict=True)})


def to_unit(points: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return points.withColumns({c: (F.col(c) - F.lit(low)) / F.lit(high - low) for c, (low, high) in ranges.items()})


def narrowed(points: DataFrame) -> DataFrame:
    """All doubles as floats, for single-precision runs."""
    return points.withColumns({c: F.col(c).cast("float") for c, kind in points.dtypes if kind == "double"})


def linear_part(points: DataFrame, scale: Sequence[float], parts: int) -> DataFrame:
    """part: the range of the coordinate with the least scale, on the unscaled axis, in ``parts`` equal ranges."""
    axis = int(np.argmin(scale))
    x = F.col(coordinates(points)[axis]) * F.lit(float(scale[axis])) * F.lit(parts)
    return points.withColumn("part", F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(parts - 1)).cast("int"))


def dealt_by_part(points: DataFrame, parts: int) -> DataFrame:
    """Points of one part in one task."""
    return points.repartition(parts, "part")


def sampled_centers(points: DataFrame, k: int, seed: int) -> DataFrame:
    """cid, c1.., : k points without replacement, in a seeded random order."""
    xs = coordinates(points)
    chosen = points.select(md5_order(F.col("point_id"), seed).alias("key"), "point_id", *xs).orderBy("key", "point_id").limit(k)
    cid = F.row_number().over(W.orderBy("key", "point_id")) - 1
    return chosen.select(cid.cast("bigint").alias("cid"), *[F.col(x).alias(f"c{i}") for i, x in enumerate(xs, 1)])


def matrix_distance(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (points x centers), coordinate by coordinate."""
    out = None
    for j in range(points.shape[1]):
        diff = points[:, j, None] - centers[None, :, j]
        diff *= diff
        out = diff if out is None else out + diff
    return out


def nearest_center(points: DataFrame, centers: DataFrame, limit: int = MAX_SHARED_CENTERS) -> DataFrame:
    """points with cid and d2 of the nearest center (ties: lowest cid)."""
    xs = coordinates(points)
    rows = centers.select("cid", *[f"c{i}" for i in range(1, len(xs) + 1)]).orderBy("cid").limit(limit + 1).toPandas()
    if len(rows) > limit:
        return nearest_center_by_region(points, centers)
    cids, matrix = rows["cid"].to_numpy(), rows.iloc[:, 1:].to_numpy(np.float64)
    width = max(1, (1 << 22) // max(1, len(matrix)))

    def run(batches):
        for batch in batches:
            table = np.column_stack([batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in xs])
            best, far = np.zeros(len(table), np.int64), np.zeros(len(table))
            for a in range(0, len(table), width):
                d2 = matrix_distance(table[a : a + width], matrix)
                at = d2.argmin(axis=1)
                best[a : a + width], far[a : a + width] = cids[at], d2[np.arange(len(at)), at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(far)], names=[*batch.schema.names, "cid", "d2"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in points.dtypes)
    return points.mapInArrow(run, f"{kinds}, cid bigint, d2 double")


def nearest_center_by_region(points: DataFrame, centers: DataFrame) -> DataFrame:
    """The same in regions of space, for numbers of centers that do not fit a task; without a distance: the lowest cid."""
    from . import regions

    xs = coordinates(points)
    sources = centers.select(F.col("cid").alias("point_id"), F.col("cid").alias("ord"), F.lit(0.0).alias("obs"), *[F.col(f"c{i}").alias(x) for i, x in enumerate(xs, 1)])
    dests = points.select(F.col("point_id").alias("dest"), F.lit(0).cast("bigint").alias("ord"), *xs).dropDuplicates(["dest"])
    found = regions.nearest(dests, sources, 1, is_test=True).select("dest", F.col("point_id").alias("cid"), "d2")
    lowest = centers.agg(F.min("cid")).first()[0]
    joined = points.join(found, F.col("point_id") == F.col("dest"), "left")
    return joined.select(*[points[c] for c in points.columns], F.coalesce("cid", F.lit(lowest).cast("bigint")).alias("cid"), F.coalesce("d2", F.lit(float("nan"))).alias("d2"))


def nearest_center_by_join(points: DataFrame, centers: DataFrame) -> DataFrame:
    """The same by a join and a grouped minimum, which says it most plainly; its pairs grow with points * centers."""
    from ..functions.geometry import squared_distance

    xs = coordinates(points)
    d2 = squared_distance([F.col(x) for x in xs], [F.col(f"c{i}") for i in range(1, len(xs) + 1)])
    pairs = points.select("point_id", *xs).join(centers, F.lit(True)).select("point_id", F.struct(d2.alias("d2"), F.col("cid").alias("cid")).alias("b"))
    best = pairs.groupBy("point_id").agg(F.min("b").alias("b"))
    return points.join(best, "point_id").select(*points.columns, F.col("b.cid").alias("cid"), F.col("b.d2").alias("d2"))


def block_sizes(assigned: DataFrame) -> DataFrame:
    """One row: least, largest and mean size of the blocks."""
    sizes = assigned.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.count(F.lit(1)).alias("blocks"))


def centroids(assigned: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """cid, c1.., n: means of the blocks' coordinates; with ``centers``, empty blocks are there with zeros."""
    xs = coordinates(assigned)
    means = assigned.groupBy("cid").agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(xs, 1)], F.count(F.lit(1)).alias("n"))
    if centers is None:
        return means
    filled = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(1, len(xs) + 1)]
    return centers.select("cid").join(means, "cid", "left").select("cid", *filled, F.coalesce("n", F.lit(0)).alias("n"))


def ordered_blocks(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks with ord, a seeded random permutation from 0."""
    return blocks.withColumn("ord", (F.row_number().over(W.orderBy(md5_order(F.col("cid"), seed), "cid")) - 1).cast("bigint"))


def classic_blocks(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every point its own block: (assigned points, centers)."""
    xs = coordinates(points)
    assigned = points.withColumns({"cid": F.col("point_id"), "d2": F.lit(0.0)})
    return assigned, points.select(F.col("point_id").alias("cid"), *[F.col(x).alias(f"c{i}") for i, x in enumerate(xs, 1)])


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Centers after one assignment and update; a center without points stays where it is."""
    moved = centroids(nearest_center(points, centers))
    d = len(coordinates(points))
    old = centers.select("cid", *[F.col(f"c{i}").alias(f"o{i}") for i in range(1, d + 1)])
    return old.join(moved, "cid", "left").select("cid", *[F.coalesce(f"c{i}", f"o{i}").alias(f"c{i}") for i in range(1, d + 1)], F.coalesce("n", F.lit(0)).alias("n"))


def weighted_draw(points: DataFrame, weight: str, seed: int) -> DataFrame:
    """One point with probability in proportion to a weight: the least -log(u) / weight (exponential races)."""
    u = F.greatest(md5_uniform(F.col("point_id"), seed), F.lit(1e-300))
    return points.where(F.col(weight) > 0).withColumn("race", -F.log(u) / F.col(weight)).orderBy("race", "point_id").limit(1).drop("race")


def kmeans_pp(points: DataFrame, k: int, iterations: int, seed: int) -> DataFrame:
    """Centers by squared-distance seeding and a fixed number of Lloyd steps; the driver holds centers only."""
    spark = points.sparkSession
    xs = coordinates(points)
    names = ["cid", *[f"c{i}" for i in range(1, len(xs) + 1)]]
    kinds = "cid bigint, " + ", ".join(f"{c} double" for c in names[1:])
    rows = [(0, *sampled_centers(points, 1, seed).select(*names[1:]).first())]
    for i in range(1, k):
        near = nearest_center(points, spark.createDataFrame(rows, kinds))
        drawn = weighted_draw(near, "d2", seed + i).select(*xs).first()
        if drawn is None:
            break  # fewer distinct points than centers
        rows.append((i, *drawn))
    for _ in range(iterations):
        step = lloyd_step(points, spark.createDataFrame(rows, kinds)).select(*names).orderBy("cid")
        rows = [tuple(r) for r in step.collect()]
    return spark.createDataFrame(rows, kinds)


def finer_partition(points: DataFrame, k: int, clustering: str, iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(assigned points, centers): every point its own block if there are at most 2 k points, else random or k-means++ centers."""
    if points.limit(2 * k + 1).count() <= 2 * k:
        return classic_blocks(points)
    centers = kmeans_pp(points, k, iterations, seed) if clustering == "kmeans++" else sampled_centers(points, k, seed)
    return nearest_center(points, centers), centers


def block_rows(assigned: DataFrame, order: DataFrame) -> DataFrame:
    """cid, ord, pts: one row for each block with its points (in point_id order)."""
    xs = coordinates(assigned)
    pts = F.sort_array(F.collect_list(F.struct("point_id", F.array(*xs).alias("coords"), "obs"))).alias("pts")
    return assigned.groupBy("cid").agg(pts).join(order.select("cid", "ord"), "cid").select("cid", "ord", "pts")
