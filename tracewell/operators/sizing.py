"""Size checks in front of broadcasts, and cutting the lineage of small intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SPREAD_BYTES = 256 * 1024 * 1024


def rows_within(frame: DataFrame, limit: int = BROADCAST_ROWS) -> int | None:
    """Row count when rows and their bytes (as JSON) are few enough for a broadcast, else None.

    Reads no more rows than it must.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in frame.columns])))
    size = frame.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(width).alias("bytes")).first()
    return size.n if size.n <= limit and (size.bytes or 0) <= BROADCAST_BYTES else None


def small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcast when its counted size allows it, otherwise unchanged."""
    return F.broadcast(frame) if rows_within(frame, limit) is not None else frame


def spread_small(frame: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Spread a small input over all cores before heavy work on each row.

    A small file is often a single split. The planner's size estimate decides, so a large input,
    which has many splits, is never moved.
    """
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > max_bytes:
        return frame
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def drop_listed(frame: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti join against a list that is usually empty or short; shuffles only when it is long."""
    n = rows_within(listed)
    if n == 0:
        return frame
    return frame.join(listed if n is None else F.broadcast(listed), list(keys), "left_anti")


def lookup_join(frame: DataFrame, table: DataFrame, keys: Sequence[str], spread: str,
                salts: int = 32) -> DataFrame:
    """Left join to a table that has one row per key.

    Broadcast when the table is counted to be small. Otherwise the table is repeated once per salt
    and rows of a hot key are spread by a hash of ``spread``, so no key lands in one task.
    """
    if rows_within(table) is not None:
        return frame.join(F.broadcast(table), list(keys), "left")
    salted = frame.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        if not _local_folder:
            _local_folder.append(tempfile.mkdtemp(prefix="tracewell-"))
        folder = _local_folder[0]
    return folder.rstrip("/")


_local_folder: list[str] = []


def settled(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept in the session's checkpoint folder.

    For small results that are both counted and joined.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(frame.sparkSession))
    return frame.checkpoint()


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder: the lineage ends there and lost executors do not matter."""
    path = f"{scratch_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def only_wanted(frame: DataFrame, wanted: DataFrame, keys: Sequence[str], bits: int = 1 << 26,
                keep: bool = True) -> DataFrame:
    """The rows of ``frame`` whose keys may be in ``wanted``; almost all others go where they are read.

    The keys of ``wanted`` set bits of a bitmap, which is broadcast: ``bits / 8`` bytes at most, however many
    keys there are. Some rows pass by chance, so an exact join has to follow; no wanted row is lost. Without ``keep``
    the result is exactly the other rows, none of which is wanted.
    """
    place = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(bits)) + 1
    held = wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("bitmap_bit_position(_place) div 8 + 1").cast("int"), F.lit(1))), 16, 10)
    set_ = F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1
    found = F.coalesce(set_, F.lit(False))
    return frame.withColumn("_place", F.coalesce(place, F.lit(1))) \
        .withColumn("_bucket", F.bitmap_bucket_number("_place")) \
        .join(F.broadcast(held), "_bucket", "left").where(found if keep else ~found).select(*frame.columns)
