"""The corpus pipeline: quality, near-duplicates, decontamination, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontamination, mixing, near_dedup, quality, queries, sharding
from tracewell.llm.common import ROW, packed, table, unpacked, written

MIX_SHARE = (9, 10)     # of the words that reach the mixture


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates.

    Rows that repeat id and text count as one document; rows without an id stay.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = packed(docs, id=F.col("doc_id"), text=F.col("text"))
    once = rows.join(kept, "id").dropDuplicates(["id", "text"])
    return unpacked(once.select(ROW).unionByName(rows.filter("id is null").select(ROW)), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, one epoch at most; the one at which a prefix ends stays whole.

    Documents without words weigh nothing and stay out.
    """
    taken = mixing.mix(docs, F.expr(queries.DOMAIN_SQL), queries.mixture_weights(), MIX_SHARE, 1,
                       queries.MIX_SEED).select(F.col("doc_id").alias("taken")).distinct()
    rows = packed(docs, id=F.col("doc_id"))
    return unpacked(rows.join(taken, F.col("id").eqNullSafe(F.col("taken")), "left_semi"), docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.assign_shards(docs, queries.SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixing_stage),
    ("shards", sharding_stage),
]

#: The classifier of the first stage has no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
