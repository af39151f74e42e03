"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import suppress
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id has fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)), F.lit(0)).cast("int")


#: A key with more than one in so many rows is hot, so that there are fewer hot keys than this.
HOT_KEYS = 1000


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], size: str, spread: Column, total: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each key and the number of its rows in ``size``.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS: their table rows are broadcast, and the rows
    that have met them are dealt by ``spread`` (of the first key's type) instead of their key. All other keys are
    joined by a shuffle, in which no key has more than that share of the rows. ``table`` is read twice or three
    times: it should be checkpointed or cheap.
    """
    if total is None:
        total = table.agg(F.sum(size)).first()[0] or 0
    values = [c for c in table.columns if c not in keys]
    is_hot = F.col(size) * HOT_KEYS > total
    hot = table.where(is_hot).select(*[F.col(c).alias(f"hot_{c}") for c in table.columns])
    cold = table.where(~is_hot).select(*[F.col(c).alias(f"cold_{c}") for c in table.columns])
    met = rows.join(F.broadcast(hot), reduce(Column.__and__, [F.col(k) == F.col(f"hot_{k}") for k in keys]), "left")
    met = met.withColumn("dealt", F.when(F.col(f"hot_{size}").isNotNull(), spread).otherwise(F.col(keys[0])))
    on = [F.col("dealt") == F.col(f"cold_{keys[0]}"), *[F.col(k) == F.col(f"cold_{k}") for k in keys[1:]]]
    both = met.join(cold, reduce(Column.__and__, on), "left")
    return both.select(*[F.col(c) for c in rows.columns], *[F.when(F.col(f"hot_{size}").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in values])


#: Slots of a table of flags: what is broadcast has so many rows at most, whatever the data.
SLOTS = 1 << 20


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def one_row_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``row`` (a struct of ``columns``): of the rows of each key the one with the least doc_id, null last.

    Rows of one id are told apart by a hash of the other columns. The aggregation combines before it shuffles, so
    that a hot key leaves every map task as one row, and rows need no identity of their own.
    """
    doc_id = F.col("doc_id").cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("hash"))
    return rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), order).alias("row"))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="fieldloom-")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Catalyst would otherwise copy the expression into every lambda that mentions it.
    """
    return F.transform(F.array(value), body)[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; choose one only where none is configured."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give a process's free memory back to the system, so that stages that follow each other do not add up."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches, max_bytes: int = 4 << 20, size_column: str = "text"):
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text (one row at least)."""
    yield from _slices(batches, max_bytes, size_column)
    release()


def _slices(batches, max_bytes: int, size_column: str):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(size_column))
        rows, step = batch.num_rows, 1
        if rows:
            step = max(1, int(rows * max_bytes / max(1, column.nbytes)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
