"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are cut into ranges by their leading digits;
ranges are summed first, an exclusive prefix sum over a source's few thousand ranges gives each range its
start, and a running sum inside a range (which holds a small, hash-even share of the rows) gives each document
its place. A source whose target exceeds its size is taken whole as often as it fits; the rest of the budget
is cut from the front of the key order, inside a document if need be, so that a source's taken words are the
integer part of its target.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating. They share ``share`` times the
total size by weight; no target exceeds ``cap`` times its source's size. Capping and resharing until none is
above has a closed form: with sources by cap / weight, the level is the largest (total - caps before) /
(weights from here on), and a target is the smaller of its cap and level * weight.

Sums over sources (a row each) run in one task; everything else is dealt by source and range.

Defined results: an empty table gives no rows; a null text has size 0 and is never taken; a source of size 0 has
target 0; a null source is a source; rows without an id get their key from the text; ties in the key are ordered by
(id, size), and by a hash of all columns where rows are returned; repeated rows count and are taken one by one; very
long texts may be cut inside, and are whole rows in :func:`mixed_rows`; extra columns, whatever their names, are
ignored by :func:`mixture` and kept by :func:`mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, documents

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Leading hexadecimal digits of the key that make a range: 16**3 ranges a source.
RANGE_DIGITS = 3
EPSILON = 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target from one row (source, source_size) for each source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    level_order = W.orderBy(F.col("ratio"), F.col("rank"))
    return (
        sizes.select("source", "source_size", rank.alias("rank"), weight.alias("weight"), F.sum("source_size").over(everything).alias("total"))
        .withColumn("ratio", F.col("source_size") * F.lit(cap) / F.col("weight"))
        .withColumn("caps_before", F.sum(F.col("source_size") * F.lit(cap)).over(level_order) - F.col("source_size") * F.lit(cap))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.sum("weight").over(level_order) + F.col("weight"))
        .withColumn("level", F.max((F.lit(share) * F.col("total") - F.col("caps_before")) / F.col("weights_left")).over(everything))
        .select("source", "source_size", F.least((F.col("source_size") * F.lit(cap)).cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, source, size, key, range, name and the extra columns of every row; rows without an id get their key from the text."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), name.alias("name"), *extra)
    return rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def range_starts(rows: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """name, range, start (words of the source before the range), source_size, target."""
    ranges = rows.groupBy("name", "source", "range").agg(F.sum("size").alias("in_range"))
    sizes = ranges.groupBy("name", "source").agg(F.sum("in_range").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("name"), "source_size", "target")
    in_order = W.partitionBy("name").orderBy("range")
    return ranges.select("name", "range", (F.sum("in_range").over(in_order) - F.col("in_range")).alias("start")).join(targets, "name")


def cut(rows: DataFrame, starts: DataFrame, *ties: str) -> DataFrame:
    """``rows`` with source_size, target and taken."""
    place = W.partitionBy("name", "range").orderBy("key", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.col("size")
    # sums of doubles may fall short of a whole target by less than EPSILON
    budget = F.floor(F.col("target") + EPSILON).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor((F.col("target") + EPSILON) / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - F.col("epochs") * F.col("source_size")
    return (
        rows.join(starts, ["name", "range"])
        .withColumn("before", F.col("start") + F.sum("size").over(place) - size)
        .withColumn("epochs", epochs)
        .withColumn("taken", (F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, rest - F.col("before")))).cast("long"))
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    # id, source, size and key only: a few bytes a document, so that the texts are read once
    rows = checkpointed(keyed(docs))
    return cut(rows, range_starts(rows, weights, share, cap)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of the mix, repeated as often as it takes them; a document taken in part is a whole row.

    Every row goes through the cut itself, with its columns in a struct, so that no row is found again by its id.
    """
    starts = range_starts(checkpointed(keyed(docs)), weights, share, cap)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = cut(keyed(docs, F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("tie")), starts, "tie")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    return rows.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, sum(source_size) OVER () AS total FROM s
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r
), l AS (
  SELECT *,
         sum(2 * source_size) OVER o - 2 * source_size AS caps_before,
         sum(weight) OVER () - sum(weight) OVER o + weight AS weights_left
  FROM w WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, rank)
), t AS (
  SELECT source, source_size,
         least((2 * source_size)::DOUBLE, max((1.5::DOUBLE * total::DOUBLE - caps_before::DOUBLE) / weights_left::DOUBLE) OVER () * weight) AS target
  FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before,
         CASE WHEN t.source_size > 0 THEN floor((t.target + 1e-6::DOUBLE) / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target + 1e-6::DOUBLE)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
