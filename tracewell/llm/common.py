"""Helpers of several operators: table reading, the shared folder, Arrow streams, text hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of its own in a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tracewell-llm-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


ROW = "_row"


def packed(frame: DataFrame, **own: Column) -> DataFrame:
    """The caller's columns as one struct ``ROW`` beside ``own`` columns, whose names can't clash with them."""
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(ROW),
                        *[value.alias(name) for name, value in own.items()])


def unpacked(frame: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return frame.select(*[F.col(ROW).getField(c).alias(c) for c in columns], *more)


def hash60(value: Column) -> Column:
    """60 bits of the MD5 of a text, as a long; any SQL engine with MD5 can compute the same."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def text_of(key: str | Column) -> Column:
    """A key as text; null becomes a text of its own."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(column.cast("string"), F.lit("\u0000null"))


def told_apart(rows: DataFrame, key: str, check: str) -> DataFrame:
    """``rows`` whose 64-bit ``key`` is hashed again with ``check`` where it stands for several of these.

    Two independent hashes of 64 bits tell contents apart at any size; a key alone has chance twins.
    """
    twins = written(rows.groupBy(key).agg(F.min(check).alias("_lo"), F.max(check).alias("_hi")).filter("_lo != _hi")
                    .select(key, F.lit(True).alias("_twin")), "twins")
    if twins.isEmpty():
        return rows
    return rows.join(twins, key, "left").withColumn(key, F.when(
        F.col("_twin"), F.xxhash64(key, check)).otherwise(F.col(key))).drop("_twin")


def byte_length(column: str) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def held_out_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in ``fold``; a null key is never held out."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(False))


# --- streams of Arrow batches ------------------------------------------------------------------

def rows_of(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[tuple]:
    """Rows of a stream of batches as tuples, converted a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield from zip(*(column.to_pylist() for column in part.columns))


def collected(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20,
              width: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``limit`` bytes from a stream of row tuples."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += width(row)
        if size >= limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)


def chunks_of(rows: Iterator[tuple], width: Callable[[tuple], int], limit: int) -> Iterator[list]:
    """Lists of consecutive rows of about ``limit`` bytes; a longer row is a list of its own."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += width(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- 64-bit mixing -----------------------------------------------------------------------------

def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (finalizer of SplitMix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
