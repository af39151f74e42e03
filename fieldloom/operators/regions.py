"""Exact nearest sources for many destinations, by regions of a k-d tree.

``sources``: point_id, ord, obs, x1..; ``dests``: dest, ord, x1... A destination takes its m nearest sources of a
lower order (``is_test``: of any order); ties go by (order, point_id).

Of sources at one place only the first m by (order, point_id) can ever be taken, so the others are left out first.
Space is cut into regions of about ``REGION`` rows along a tree from a bounded sample, which only decides who works
where. A destination meets the sources of its own region; its m-th distance bounds what other regions could add, and
it visits just those whose sources' bounding box is within that bound. Distances to boxes are computed like those to
points, and rounding is monotone, so that no source is missed. Where the own region has too few earlier sources, the
``HEAD`` first sources of all give the bound. Work and shuffles grow with the rows, not with pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import coordinates

#: Rows of a region, about; sources that bound early destinations; rows of the sample; distances in memory at once.
REGION, HEAD, SAMPLE, CELLS = 4096, 4096, 200_000, 1 << 21
#: Tasks that the regions are dealt to, at most.
TASKS = 1024


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: in the checkpoint folder where one is set, else in Spark's cache."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    return df.persist() if spark.sparkContext.getCheckpointDir() is None else df.checkpoint(eager=True)


@dataclass
class Tree:
    """Inner nodes as arrays; a child below zero is the region -child - 1. low, high: the regions' cells, half open."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        if not len(self.axis):
            return at
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            at[inner] = np.where(x[inner, self.axis[n]] >= self.cut[n], self.right[n], self.left[n])
        return -at - 1


def grown(sample: np.ndarray, regions: int) -> Tree:
    """A tree with up to so many regions of equal shares of the sample, cut across the longest side."""
    d = sample.shape[1]
    nodes: list[list] = []
    cells: list[tuple] = []

    def grow(x: np.ndarray, share: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = np.ptp(x, axis=0) if len(x) > 1 else np.zeros(d)
        axis = int(spread.argmax())
        if share < 2 or spread[axis] == 0:
            cells.append((low, high))
            return -len(cells)
        values = x[:, axis]
        cut = np.median(values)
        if cut == values.min():
            cut = values[values > cut].min()
        at = len(nodes)
        nodes.append([axis, cut, 0, 0])
        over = values >= cut
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        part = min(share - 1, max(1, round(share * float((~over).mean()))))
        nodes[at][2] = grow(x[~over], part, low, below)
        nodes[at][3] = grow(x[over], share - part, above, high)
        return at

    grow(sample, regions, np.full(d, -np.inf), np.full(d, np.inf))
    axis, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0),) * 4
    return Tree(axis.astype(np.int64), cut.astype(np.float64), left.astype(np.int64), right.astype(np.int64), np.array([c[0] for c in cells]), np.array([c[1] for c in cells]))


def _matrix(batch, first: int, d: int) -> np.ndarray:
    return np.column_stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(d)]).reshape(-1, d)


def _distance(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    from .blocks import matrix_distance

    return matrix_distance(points, others)


def _box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (points x boxes), summed like those between points."""
    out = None
    for j in range(points.shape[1]):
        x = points[:, j, None]
        gap = np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0.0)
        gap *= gap
        out = gap if out is None else out + gap
    return out


def _first_m(d2: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 1) of the m least finite values of each row; ties go to the first column."""
    if m == 1 and d2.shape[1]:
        cols = d2.argmin(axis=1)
        rows = np.flatnonzero(np.isfinite(d2[np.arange(len(d2)), cols]))
        return rows, cols[rows], np.ones(len(rows), np.int64)
    wanted = np.isfinite(d2)
    if d2.shape[1] > m:
        wanted &= d2 <= np.partition(d2, m - 1, axis=1)[:, m - 1, None]
    rows, cols = np.nonzero(wanted)
    order = np.lexsort((cols, d2[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(len(d2)))
    rank = np.arange(len(rows)) - starts[rows] + 1
    near = rank <= m
    return rows[near], cols[near], rank[near]


def nearest(dests: DataFrame, sources: DataFrame, m: int, far: float = np.inf, always: int = -1, is_test: bool = False, region: int | None = None) -> DataFrame:
    """dest, rank, point_id, d2, p_ord, obs, x1..: every destination's m nearest earlier sources.

    Pairs at a distance of ``far`` or more count only for destinations up to the order ``always``, and never if
    ``is_test``. Rows with a coordinate that is null or not finite have no distance and are left out.
    """
    xs = coordinates(sources)
    d = len(xs)
    finite = " and ".join(f"abs({x}) < double('infinity')" for x in xs)
    place = W.partitionBy(*xs).orderBy("ord", "point_id")
    first = sources.where(finite).select("point_id", "ord", "obs", *xs).withColumn("k", F.row_number().over(place)).where(F.col("k") <= m).drop("k")
    first, dests = kept(first), kept(dests.where(finite).select("dest", "ord", *xs))
    rows = first.count()
    share = max(1, -(-rows // SAMPLE))
    sample = first.where(F.pmod(F.xxhash64("point_id", *xs), F.lit(share)) == 0).select(*xs).toPandas().to_numpy(np.float64)
    tree = grown(sample, max(1, (rows + dests.count()) // (region or REGION)))
    head = first.orderBy("ord", "point_id").limit(HEAD).select("ord", *xs).toPandas()
    head_ord, head_x = head["ord"].to_numpy(np.int64), head[xs].to_numpy(np.float64)
    kinds = "region int, kind int, ord bigint, id bigint, obs double, bound double, " + ", ".join(f"{x} double" for x in xs)
    names = ["region", "kind", "ord", "id", "obs", "bound", *xs]

    def placed(rows: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                where = tree.place(_matrix(batch, 6, d)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns[1:]], names=names)

        return rows.mapInArrow(run, kinds)

    nothing = F.lit(None).cast("double")
    here = kept(placed(first.select(F.lit(0).alias("region"), F.lit(0).alias("kind"), "ord", F.col("point_id").alias("id"), "obs", nothing.alias("bound"), *xs)))
    asking = placed(dests.select(F.lit(0).alias("region"), F.lit(1).alias("kind"), "ord", F.col("dest").alias("id"), nothing.alias("obs"), nothing.alias("bound"), *xs))
    boxes = here.groupBy("region").agg(*[F.min(x).alias(f"low_{x}") for x in xs], *[F.max(x).alias(f"high_{x}") for x in xs]).orderBy("region").toPandas()
    box_region = boxes["region"].to_numpy(np.int32)
    box_low, box_high = boxes[[f"low_{x}" for x in xs]].to_numpy(np.float64), boxes[[f"high_{x}" for x in xs]].to_numpy(np.float64)
    tasks = max(1, min(TASKS, len(tree.low)))
    out_names = ["step", "region", "dest", "rank", "ord", "bound", *[f"c{j}" for j in range(1, d + 1)], "point_id", "d2", "p_ord", "obs", *xs]
    out_kinds = "step int, region int, dest bigint, rank bigint, ord bigint, bound double, " + ", ".join(f"c{j} double" for j in range(1, d + 1)) + ", point_id bigint, d2 double, p_ord bigint, obs double, " + ", ".join(f"{x} double" for x in xs)
    out_schema = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[k.split()[-1]]) for n, k in zip(out_names, out_kinds.split(","), strict=True)])

    def record(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in out_schema], schema=out_schema)

    def met(batch: pa.RecordBatch, held: pa.RecordBatch | None, again: bool):
        """Rows of step 0 (final), 1 (to be ranked with those of other regions) and 2 (visits to other regions)."""
        own, orders = _matrix(batch, 6, d), batch.column(2).to_numpy(zero_copy_only=False)
        limited = np.full(len(own), np.isfinite(far)) & (is_test | (orders > always))
        d2 = np.full((len(own), 0), np.inf)
        if held is not None:
            d2 = _distance(own, _matrix(held, 6, d))
            if not is_test:
                d2[held.column(2).to_numpy(zero_copy_only=False)[None, :] >= orders[:, None]] = np.inf
            if limited.any():
                d2[limited[:, None] & (np.sqrt(d2) >= far)] = np.inf
            if again:
                d2[d2 > batch.column(5).to_numpy(zero_copy_only=False)[:, None]] = np.inf
        rows, cols, rank = _first_m(d2, m)
        step = np.ones(len(own), np.int32)
        if not again:
            bound = np.full(len(own), np.inf)
            bound[rows[rank == m]] = d2[rows[rank == m], cols[rank == m]]
            if (short := np.flatnonzero(np.isinf(bound))).size and len(head_x) >= m:
                for some in np.array_split(short, 1 + short.size * len(head_x) // CELLS):
                    h2 = _distance(own[some], head_x)
                    if not is_test:
                        h2[head_ord[None, :] >= orders[some, None]] = np.inf
                    bound[some] = np.partition(h2, m - 1, axis=1)[:, m - 1]
            region = batch.column(0)[0].as_py()
            gap = np.minimum(own - tree.low[region], tree.high[region] - own).min(axis=1)
            gap2 = np.where(gap > 0, gap * gap, 0.0)
            crossing = np.flatnonzero((gap2 <= bound) & ~(limited & (np.sqrt(gap2) >= far)))
            step[:] = 0
            for some in np.array_split(crossing, 1 + crossing.size * len(box_low) // CELLS) if crossing.size else ():
                b2 = _box_distance(own[some], box_low, box_high)
                go = (b2 <= bound[some, None]) & (box_region != region)[None, :] & ~(limited[some, None] & (np.sqrt(b2) >= far))
                p, b = np.nonzero(go)
                if len(p):
                    step[some[p]] = 1
                    taken = batch.take(pa.array(some[p]))
                    yield record(len(p), step=np.full(len(p), 2), region=box_region[b], dest=taken.column(3), ord=taken.column(2), bound=bound[some[p]], **{f"c{j + 1}": taken.column(6 + j) for j in range(d)})
        if len(rows):
            asked, found = batch.take(pa.array(rows)), held.take(pa.array(cols))
            yield record(len(rows), step=step[rows], dest=asked.column(3), rank=rank, point_id=found.column(3), d2=d2[rows, cols], p_ord=found.column(2), obs=found.column(4), **{x: found.column(6 + j) for j, x in enumerate(xs)})

    def search(again: bool):
        def run(batches):
            current, parts, held = None, [], None
            for batch in batches:
                region, kind = (batch.column(k).to_numpy() for k in (0, 1))
                border = np.flatnonzero((region[1:] != region[:-1]) | (kind[1:] != kind[:-1])) + 1
                for a, b in zip([0, *border.tolist()], [*border.tolist(), len(region)], strict=True):
                    if a == b:
                        continue
                    if region[a] != current:
                        current, parts, held = region[a], [], None
                    if kind[a] == 0:
                        parts.append(batch.slice(a, b - a))
                        continue
                    if held is None and parts:
                        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    step = max(1, CELLS // max(1, held.num_rows if held is not None else 1))
                    for start in range(a, b, step):
                        yield from met(batch.slice(start, min(step, b - start)), held, again)

        return run

    def dealt(rows: DataFrame, again: bool) -> DataFrame:
        sorted_rows = here.unionByName(rows).repartition(tasks, "region").sortWithinPartitions("region", "kind", "ord", "id")
        return sorted_rows.mapInArrow(search(again), out_kinds)

    own = kept(dealt(asking, False))
    visits = own.where("step = 2").select("region", F.lit(1).alias("kind"), "ord", F.col("dest").alias("id"), nothing.alias("obs"), "bound", *[F.col(f"c{j}").alias(x) for j, x in enumerate(xs, 1)])
    columns = ["dest", "point_id", "d2", "p_ord", "obs", *xs]
    rest = own.where("step = 1").select(*columns).unionByName(dealt(visits, True).select(*columns))
    ranked = rest.withColumn("rank", F.row_number().over(W.partitionBy("dest").orderBy("d2", "p_ord", "point_id"))).where(F.col("rank") <= m)
    shape = ["dest", "point_id", "d2", "p_ord", "obs", *xs, "rank"]
    return own.where("step = 0").select(*shape).unionByName(ranked.withColumn("rank", F.col("rank").cast("bigint")).select(*shape))
