"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash. A bucket that exceeds the byte limit splits on
one more bit, and only such a bucket does; a shard is the shallowest prefix that fits. The first 60
bits hash the key, the next 60 the whole row, so rows of one hot key are told apart as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ROW, byte_length, fresh_path, hash60, packed, text_of, unpacked, written

WORD = 60           # bits of one hash word
EXTRA_BITS = 3      # the first directory is this much deeper than an even split needs
STEP = 20           # bits that later rounds add for buckets that are still too large


def _prefix(word: int, depth: Column) -> Column:
    """Leading bits of hash word 0 or 1 at a directory depth of 0 to 120."""
    bits = F.least(F.greatest(depth - WORD * word, F.lit(0)), F.lit(WORD))
    return F.call_function("shiftright", F.col(f"_h{word}"), (F.lit(WORD) - bits).cast("int"))


def _with_hashes(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """The caller's columns as one struct, two hash words, and the bytes."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return packed(rows, _h0=hash60(text_of(F.col(f"`{key}`"))), _h1=hash60(F.to_json(F.struct(*columns))),
                  _size=F.coalesce(size, F.lit(0)).cast("long"))


def _leaves(cells: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """For each cell of depth ``last`` the shallowest depth from ``first`` on whose bucket fits."""
    levels = cells.select("_p0", "_p1", "_bytes", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_d"))

    def above(word):
        own = min(max(last - WORD * word, 0), WORD)
        bits = F.least(F.greatest(F.col("_d") - WORD * word, F.lit(0)), F.lit(WORD))
        return F.call_function("shiftright", F.col(f"_p{word}"), (F.lit(own) - bits).cast("int"))

    levels = levels.withColumns({"_b0": above(0), "_b1": above(1)})
    fitting = levels.groupBy("_d", "_b0", "_b1").agg(F.sum("_bytes").alias("_sum")) \
        .filter(F.col("_sum") <= limit)
    return levels.join(fitting, ["_d", "_b0", "_b1"]).groupBy("_p0", "_p1") \
        .agg(F.min("_d").alias("_leaf"))


def directory(keys: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Directories ``(depth, cells -> _leaf)``: one, and further ones only for oversized buckets.

    ``keys`` has the hash words and the bytes of each distinct pair of them. A cell without a leaf
    is split further by the next directory.
    """
    total = keys.agg(F.sum("_bytes")).first()[0] or 0
    depth = max(1, math.ceil(math.log2(max(1, total / limit))) + EXTRA_BITS)
    first, found = 0, []
    while first <= 2 * WORD:
        depth = min(depth, 2 * WORD)
        at = F.lit(depth)
        cells = keys.groupBy(_prefix(0, at).alias("_p0"), _prefix(1, at).alias("_p1")) \
            .agg(F.sum("_bytes").alias("_bytes"))
        cells = written(cells.join(_leaves(cells, first, depth, limit), ["_p0", "_p1"], "left")
                        .select("_p0", "_p1", "_leaf"), "directory")
        found.append((depth, cells.filter("_leaf is not null")))
        full = cells.filter("_leaf is null").select("_p0", "_p1")
        if full.isEmpty():
            break
        keys = keys.join(full.withColumnsRenamed({"_p0": "_f0", "_p1": "_f1"}),
                         (_prefix(0, at) == F.col("_f0")) & (_prefix(1, at) == F.col("_f1")), "left_semi")
        first, depth = depth + 1, depth + STEP
    return found


def assign_shards(rows: DataFrame, limit: int, key: str = "doc_id", text: str = "text",
                  size: Column | None = None) -> DataFrame:
    """``rows`` with ``shard_id`` (text) such that each shard holds at most ``limit`` bytes.

    The id is the depth and the prefix of the bucket. The size of a row is the UTF-8 length of
    ``text`` unless ``size`` gives another. A row larger than the limit is a shard of its own
    (``solo-``); equal rows that no bit can part fill pages of the limit (``page-``). Null keys hash
    as a text of their own, null texts count zero bytes, an empty table stays empty. Extra columns
    are kept, whatever their names; only a column ``shard_id`` of the caller gives way to the new one.
    """
    columns = [c for c in rows.columns if c != "shard_id"]
    hashed = _with_hashes(rows, key, byte_length(f"`{text}`") if size is None else size)
    keys = written(hashed.filter(F.col("_size") <= limit).groupBy("_h0", "_h1")
                   .agg(F.sum("_size").alias("_bytes")), "shard-keys")
    found = hashed.withColumn("_shard", F.lit(None).cast("string"))
    for depth, cells in directory(keys, limit):
        at = F.lit(depth)
        found = found.withColumns({"_q0": _prefix(0, at), "_q1": _prefix(1, at)}) \
            .join(cells.withColumnsRenamed({"_p0": "_q0", "_p1": "_q1"}), ["_q0", "_q1"], "left")
        leaf = F.col("_leaf")
        name = F.concat_ws("-", leaf, _prefix(0, leaf), F.when(leaf > WORD, _prefix(1, leaf)))
        found = found.withColumn("_shard", F.coalesce("_shard", F.when(
            (F.col("_size") <= limit) & leaf.isNotNull(), name))).drop("_q0", "_q1", "_leaf")
    fitting = found.filter("_shard is not null")
    rest = found.filter("_shard is null").groupBy(ROW, "_h0", "_h1", "_size").agg(F.count("*").alias("_n"))
    per_page = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(_size, 1)"))
    rest = rest.withColumn("_ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rest = rest.withColumn("_shard", F.concat_ws(
        "-", F.when(F.col("_size") > limit, "solo").otherwise("page"), "_h0", "_h1",
        F.floor(F.col("_ordinal") / per_page)))
    shard = F.col("_shard").alias("shard_id")
    return unpacked(fitting, columns, shard).unionByName(unpacked(rest, columns, shard))


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """Writes one folder per shard and a manifest of rows per shard; returns the path."""
    path = path or fresh_path(sharded.sparkSession, "shards")
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(f"{path}/data")
    sharded.groupBy("shard_id").agg(F.count("*").alias("n_rows")).write.parquet(f"{path}/manifest")
    return path
