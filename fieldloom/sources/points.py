"""Point sources: (point_id, x1, x2, ..., obs).

Points come from delimited files, from generators that any engine can reproduce (md5 uniforms), or from views
over relational tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import md5_uniform

#: The input ranges of the borehole function (rw, r, Tu, Hu, Tl, Hl, L, Kw).
BOREHOLE_RANGES = ((0.05, 0.15), (100.0, 50000.0), (63070.0, 115600.0), (990.0, 1110.0), (63.1, 116.0), (700.0, 820.0), (1120.0, 1680.0), (1500.0, 15000.0))


def csv_schema(dim: int) -> T.StructType:
    return T.StructType([T.StructField(f"x{k}", T.DoubleType()) for k in range(1, dim + 1)] + [T.StructField("obs", T.DoubleType())])


def read_csv_points(spark: SparkSession, path: str, dim: int, mode: str = "FAILFAST") -> DataFrame:
    """Points of a comma-separated file without header: dim coordinates, then the observation; more columns are ignored.

    FAILFAST stops at a malformed row, DROPMALFORMED leaves it out. point_id follows the order of the file.
    """
    lines = spark.read.text(path)
    return number_rows(parse_csv_lines(lines, dim, mode))


def parse_csv_lines(lines: DataFrame, dim: int, mode: str = "FAILFAST") -> DataFrame:
    """x1.., obs from a column ``value`` of comma-separated lines; other columns are kept."""
    parts = F.split(F.col("value"), ",")
    fields = [F.try_element_at(parts, F.lit(k)) for k in range(1, dim + 2)]
    numbers = [F.trim(f).try_cast("double") for f in fields]
    good = numbers[0].isNotNull()
    for n in numbers[1:]:
        good = good & n.isNotNull()
    names = [f"x{k}" for k in range(1, dim + 1)] + ["obs"]
    others = [c for c in lines.columns if c != "value"]
    if mode == "DROPMALFORMED":
        return lines.where(good).select(*others, *[n.alias(c) for n, c in zip(numbers, names, strict=True)])
    if mode != "FAILFAST":
        raise ValueError(f"unknown mode {mode!r}")
    checked = F.when(good, F.struct(*[n.alias(c) for n, c in zip(numbers, names, strict=True)])).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.col("value"))))
    return lines.select(*others, checked.alias("p")).select(*others, "p.*")


def number_rows(df: DataFrame) -> DataFrame:
    """point_id from 0, in the order of the input's partitions, without gathering rows in one place."""
    marked = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright(F.col("_row"), 33))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("start"))
    # one row for each partition of the input
    numbered = marked.join(F.broadcast(starts), "_part")
    return numbered.select((F.col("start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).alias("point_id"), *df.columns)


def first_points(points: DataFrame, n: int) -> DataFrame:
    """The first n points by point_id."""
    return points.orderBy("point_id").limit(n)


def uniform_points(spark: SparkSession, n: int, dim: int, seed: int = 0, observe: bool = True) -> DataFrame:
    """Uniform coordinates; uniform observations, or zeros."""
    key = F.col("id")
    xs = [md5_uniform(key, seed * 100 + k).alias(f"x{k}") for k in range(1, dim + 1)]
    obs = md5_uniform(key, seed * 100) if observe else F.lit(0.0)
    return spark.range(n).select(F.col("id").alias("point_id"), *xs, obs.alias("obs"))


def random_points(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Uniform points from Spark's own generator: faster, but not reproducible in other engines."""
    return spark.range(n).select(F.col("id").alias("point_id"), *[F.rand(seed * 100 + k).alias(f"x{k}") for k in range(1, dim + 1)], F.rand(seed * 100).alias("obs"))


def normal_values(df: DataFrame, mean: float, sd: float, seed: int, name: str = "value") -> DataFrame:
    return df.withColumn(name, F.randn(seed) * F.lit(sd) + F.lit(mean))


def smooth_points(ids: DataFrame) -> DataFrame:
    """Points with real spatial signal over the ids of a column point_id."""
    key = F.col("point_id")
    x = ids.select("point_id", md5_uniform(key, 1).alias("x1"), md5_uniform(key, 2).alias("x2"), md5_uniform(key, 3).alias("u"))
    return x.select("point_id", "x1", "x2", (F.sin(6.0 * F.col("x1")) + F.cos(4.0 * F.col("x2")) + 0.1 * (F.col("u") - 0.5)).alias("obs"))


def disc_points(ids: DataFrame, n: float) -> DataFrame:
    """Points of the disc of radius 1 / n, by rejection from its square; ``inner`` within 1 / (n sqrt 3)."""
    key, radius = F.col("point_id"), 1.0 / n
    square = ids.select("point_id", ((2.0 * md5_uniform(key, 1) - 1.0) * radius).alias("x1"), ((2.0 * md5_uniform(key, 2) - 1.0) * radius).alias("x2"))
    r2 = F.col("x1") * F.col("x1") + F.col("x2") * F.col("x2")
    return square.where(r2 <= radius * radius).withColumn("inner", r2 <= radius * radius / 3.0)


def borehole_response(rw, r, tu, hu, tl, hl, length, kw):
    """Water flow through a borehole."""
    ratio = F.log(r / rw)
    return 2.0 * F.lit(3.141592653589793) * tu * (hu - hl) / (ratio * (1.0 + 2.0 * length * tu / (ratio * rw * rw * kw) + tu / tl))


def borehole_points(ids: DataFrame, is_test: bool = False) -> DataFrame:
    """Eight inputs scaled to [0, 1] and the response in standard units of the training ids (point_id % 10 <> 0)."""
    key = F.col("point_id")
    unit = ids.select("point_id", *[md5_uniform(key, k).alias(f"x{k}") for k in range(1, 9)])
    raw = [F.lit(low) + F.col(f"x{k}") * F.lit(high - low) for k, (low, high) in enumerate(BOREHOLE_RANGES, 1)]
    with_y = unit.withColumn("y", borehole_response(*raw))
    is_train = F.col("point_id") % 10 != 0
    moments = with_y.where(is_train).agg(F.avg("y").alias("mean_y"), F.avg(F.col("y") * F.col("y")).alias("mean_y2"))
    scaled = with_y.where(~is_train if is_test else is_train).crossJoin(F.broadcast(moments))  # one row
    z = (F.col("y") - F.col("mean_y")) / F.sqrt(F.col("mean_y2") - F.col("mean_y") * F.col("mean_y"))
    return scaled.select("point_id", *[f"x{k}" for k in range(1, 9)], z.alias("obs"))


# -- views over the relational tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by size and price; observed: the mean unit price of their line items, in standard units."""
    price = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    parts = table(spark, sf_dir, "part").join(price, F.col("p_partkey") == F.col("l_partkey"))
    moments = price.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return parts.crossJoin(F.broadcast(moments)).select(
        F.col("p_partkey").cast("bigint").alias("point_id"),
        (F.col("p_size") / 50.0).alias("x1"),
        ((F.col("p_retailprice") - 900.0) / 100.0).alias("x2"),
        F.round((F.col("v") - F.col("m")) / F.col("s"), 9).alias("obs"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by time (in 30 days from 2024) and user; observed: the logarithm of the value."""
    events = table(spark, sf_dir, "events")
    users = events.agg((F.max("user_id") + 1).alias("users"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return events.crossJoin(F.broadcast(users)).select(
        F.col("event_id").cast("bigint").alias("point_id"),
        (micros / F.lit(30.0 * 86400.0 * 1e6)).alias("x1"),
        (F.col("user_id") / F.col("users")).alias("x2"),
        F.log1p("value").alias("obs"),
    )


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by quantity, discount, tax and day; observed: the unit price.

    The id is a number made of the order key and a line's place among its order's lines, so that no global sort is needed.
    """
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return items.select(
        (F.col("l_orderkey") * 1000 + F.col("place")).alias("point_id"),
        (F.col("l_quantity") / 50.0).alias("x1"),
        (F.col("l_discount") / 0.1).alias("x2"),
        (F.col("l_tax") / 0.08).alias("x3"),
        (days / 2500.0).alias("x4"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("obs"),
    )


def embed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, coords (array of doubles), obs: embeddings and their label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"), F.col("label").cast("double").alias("obs"))


def ids_of(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(column).cast("bigint").alias("point_id"))
