"""Candidate blocks and nearest earlier points.

``blocks``: cid, c1.., ord. ``points``: point_id, x1.., obs, cid. A block may only look at points of blocks that
come earlier in the random order; test blocks look at all training points.

The top-m join keeps, for each Arrow batch of points, only the pairs that can still be among a block's m
nearest; a window with a rank limit then decides. What is shuffled grows with blocks * m * tasks, not with
blocks * points. Beyond ``SHARED_BLOCKS`` blocks, points and blocks meet in regions of space instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import coordinates, squared_distance
from . import regions
from .blocks import matrix_distance

#: Blocks up to this order take points at any distance, so that early blocks have donors.
ALWAYS_DONATED = 200
#: Source blocks below these orders are candidates of every later block.
FIRST_BLOCKS, FIRST_BLOCKS_CLASSIC = 42, 300
TEST_ORDER = 2147483647
#: Blocks that every batch of points is held against, at most.
SHARED_BLOCKS = 4096


def centers_of(blocks: DataFrame, prefix: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{prefix}{c}") for c in ["cid", "ord", *coordinates(blocks, "c")]])


def candidate_order_join(blocks: DataFrame, threshold: float, classic: bool = False) -> DataFrame:
    """src, dest: earlier blocks within threshold / dimension, or among the first blocks."""
    d = len(coordinates(blocks, "c"))
    a, b = centers_of(blocks, "a_"), centers_of(blocks, "b_")
    d2 = squared_distance([F.col(f"a_c{i}") for i in range(1, d + 1)], [F.col(f"b_c{i}") for i in range(1, d + 1)])
    always = FIRST_BLOCKS_CLASSIC if classic else FIRST_BLOCKS
    near = (F.col("a_ord") < always) | (F.sqrt(d2) < F.lit(threshold / d))
    return a.join(b, (F.col("a_ord") < F.col("b_ord")) & near).select(F.col("a_cid").alias("src"), F.col("b_cid").alias("dest")).distinct()


def candidate_range_join(train: DataFrame, test: DataFrame, threshold: float) -> DataFrame:
    """src, dest: training blocks within the threshold of test blocks, by an equi-join on grid cells.

    Cells are as wide as the threshold, so that partners are in the same or a neighbouring cell.
    """
    d = len(coordinates(train, "c"))
    gridded = min(d, 3)
    cells = [f"g{i}" for i in range(1, gridded + 1)]
    a = centers_of(train, "a_").withColumns({g: F.floor(F.col(f"a_c{i}") / F.lit(threshold)) for i, g in enumerate(cells, 1)})
    b = centers_of(test, "b_")
    for i, g in enumerate(cells, 1):
        own = F.floor(F.col(f"b_c{i}") / F.lit(threshold))
        b = b.withColumn(g, F.explode(F.array(own - 1, own, own + 1)))
    d2 = squared_distance([F.col(f"a_c{i}") for i in range(1, d + 1)], [F.col(f"b_c{i}") for i in range(1, d + 1)])
    return a.join(b, cells).where(F.sqrt(d2) < F.lit(threshold)).select(F.col("a_cid").alias("src"), F.col("b_cid").alias("dest")).distinct()


def with_order(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points with the order of their block."""
    return points.join(blocks.select("cid", "ord"), "cid")


def _ranked(pairs: DataFrame, m: int) -> DataFrame:
    w = W.partitionBy("dest").orderBy("d2", "p_ord", "point_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).withColumn("rank", F.col("rank").cast("bigint"))


def nearest_earlier(blocks: DataFrame, points: DataFrame, m: int, threshold: float | None = None, is_test: bool = False, limit: int = SHARED_BLOCKS) -> DataFrame:
    """dest, rank, point_id, d2, p_ord and the point's coordinates and observation: each block's m nearest earlier points.

    ``points`` carry ord. Ties go by (block order, point_id). With a threshold, blocks beyond order 200 only take
    points within it. Test blocks take points of any order.
    """
    xs = coordinates(points)
    names = ["cid", "ord", *[f"c{i}" for i in range(1, len(xs) + 1)]]
    rows = blocks.select(*names).orderBy("ord", "cid").limit(limit + 1).toPandas()
    columns = ["point_id", "ord", "obs", *xs]
    if len(rows) > limit:
        dests = blocks.select(F.col("cid").alias("dest"), "ord", *[F.col(f"c{i}").alias(x) for i, x in enumerate(xs, 1)])
        far = np.inf if threshold is None else threshold
        return regions.nearest(dests, points, m, far, ALWAYS_DONATED, is_test)
    cids, orders, matrix = rows["cid"].to_numpy(np.int64), rows["ord"].to_numpy(np.int64), rows.iloc[:, 2:].to_numpy(np.float64)
    source = points.select(*columns)
    far = np.inf if threshold is None else threshold

    def run(batches):
        best = np.full(len(matrix), np.inf)
        step = max(1, (1 << 22) // max(1, len(matrix)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                table = np.column_stack([batch.column(3 + j).to_numpy(zero_copy_only=False) for j in range(len(xs))])
                ord_ = batch.column(1).to_numpy(zero_copy_only=False)
                d2 = matrix_distance(table, matrix)
                if not is_test:
                    d2[ord_[:, None] >= orders[None, :]] = np.inf
                if np.isfinite(far):
                    d2[(np.sqrt(d2) >= far) & ((orders > ALWAYS_DONATED) | is_test)[None, :]] = np.inf
                if len(d2) >= m:
                    best = np.minimum(best, np.partition(d2, m - 1, axis=0)[m - 1])
                p, b = np.nonzero((d2 <= best[None, :]) & np.isfinite(d2))
                if len(p):
                    taken = batch.take(pa.array(p))
                    yield pa.RecordBatch.from_arrays([pa.array(cids[b]), taken.column(0), pa.array(d2[p, b]), *taken.columns[1:]], names=["dest", "point_id", "d2", "p_ord", "obs", *xs])

    pairs = source.mapInArrow(run, "dest bigint, point_id bigint, d2 double, p_ord bigint, obs double, " + ", ".join(f"{x} double" for x in xs))
    return _ranked(pairs, m)


def nearest_earlier_by_join(blocks: DataFrame, points: DataFrame, m: int, threshold: float | None = None, is_test: bool = False) -> DataFrame:
    """The same as a theta join, which says it most plainly; its pairs grow with blocks * points."""
    xs = coordinates(points)
    b = centers_of(blocks, "b_")
    p = points.select("point_id", F.col("ord").alias("p_ord"), "obs", *xs)
    d2 = squared_distance([F.col(f"b_c{i}") for i in range(1, len(xs) + 1)], [F.col(x) for x in xs])
    on = F.lit(True) if is_test else F.col("p_ord") < F.col("b_ord")
    if threshold is not None:
        on = on & ((F.sqrt(d2) < F.lit(threshold)) | ((F.col("b_ord") <= ALWAYS_DONATED) & F.lit(not is_test)))
    return _ranked(p.join(b, on).select(F.col("b_cid").alias("dest"), "point_id", d2.alias("d2"), "p_ord", "obs", *xs), m)


def filled(chosen: DataFrame, candidates: DataFrame, blocks: DataFrame, points: DataFrame, m: int) -> DataFrame:
    """chosen plus, for blocks with fewer than m (but some) neighbours, further points of candidate blocks.

    A point counts as present if one with its coordinates is; more come in the order (block order, point_id), and
    ranks are by distance again.
    """
    xs = coordinates(points)
    counts = chosen.groupBy("dest").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < m)
    b = centers_of(blocks, "b_")
    pool = candidates.join(counts, "dest").join(points.select(F.col("cid").alias("src"), "point_id", F.col("ord").alias("p_ord"), "obs", *xs), "src")
    pool = pool.join(chosen.select("dest", *xs).distinct(), ["dest", *xs], "left_anti")
    pool = pool.join(b, F.col("dest") == F.col("b_cid")).where(F.col("b_ord") > 0)
    d2 = squared_distance([F.col(f"b_c{i}") for i in range(1, len(xs) + 1)], [F.col(x) for x in xs])
    w = W.partitionBy("dest").orderBy("p_ord", "point_id")
    more = pool.withColumn("k", F.row_number().over(w)).where(F.col("k") <= m - F.col("have")).select("dest", "point_id", d2.alias("d2"), "p_ord", "obs", *xs)
    return _ranked(chosen.select("dest", "point_id", "d2", "p_ord", "obs", *xs).unionByName(more), m)


def candidate_points(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """dest, n: points in the candidate blocks of each block."""
    sizes = points.groupBy(F.col("cid").alias("src")).agg(F.count(F.lit(1)).alias("k"))
    return candidates.join(sizes, "src").groupBy("dest").agg(F.sum("k").alias("n"))
