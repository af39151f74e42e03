"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside groups, keep one stable id.

Hashes are counted first; only texts whose hash may occur again go on. To tell these, the repeated hashes set
flags in a table of ``common.SLOTS`` slots, which is broadcast (its size is bounded; where it fills up, more texts go on,
with the same result). They are grouped by (hash, text) with a map-side combine, so that a group of copies
leaves every map task as one row, and texts that only share the hash stay apart: their bytes are compared as a
grouping key. Each row then finds its group by the hash and the text's SHA-256; text itself is not joined, and
hot groups are broadcast. Two different texts that agree in both hashes are found by the byte comparison and stop
the job instead of being merged.

Defined results: an empty table gives no rows; null and empty texts are equal; of equal texts the largest doc_id
stays (null ids only if there is no other); rows that tie in text and id are one document to
:func:`exact_groups`, which reports them alike; :func:`drop_copies` keeps one row of every distinct text, of tied
rows one by a hash of all columns; texts of any length are hashed and compared whole; extra columns, whatever
their names, are ignored by :func:`exact_groups` and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, id_and_text, joined_by_key, slot


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def repeated_texts(rows: DataFrame) -> DataFrame:
    """h, sha, keep_id, group_size of every text that occurs twice or more, from rows (doc_id, text, h)."""
    again = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(slot(F.col("h")).alias("slot")).distinct()
    maybe = rows.join(F.broadcast(checkpointed(again)), slot(F.col("h")) == F.col("slot"), "left_semi")
    same = maybe.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = same.select("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "keep_id", "group_size").groupBy("h", "sha")
    found = by_hash.agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("n"))
    checked = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("different texts share both hashes"))).cast("long")
    return checkpointed(found.select("h", "sha", "keep_id", checked.alias("group_size")).where("group_size > 1"))


def exact_groups(docs: DataFrame, hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = id_and_text(docs).withColumn("h", hash128(F.col("text")))
    groups = repeated_texts(rows)
    hashed = rows.select("doc_id", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    spread = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    alone = F.col("group_size").isNull()
    found = joined_by_key(hashed, groups, ["h", "sha"], "group_size", spread)
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of ``docs`` that stay, one of every distinct text, with all their columns."""
    rest = [c for c in docs.columns if c != "text"]
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)])
    # the largest id; null is the least
    order = F.struct(doc_id.alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    same = docs.select(hash128(text).alias("h"), text.alias("t"), row.alias("row"), order.alias("order")).groupBy("h", "t").agg(F.max_by("row", "order").alias("row"))
    place = {c: F.col(f"row.c{k}") for k, c in enumerate(rest)}
    place["text"] = F.when(~F.col("row.none"), F.col("t"))
    return same.select(*[place[c].alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
