"""Interaction of filters: what each order of them removes, and what only one of them finds.

Rows are dealt by ranges of ``(part, id)``. Each block of a range holds, for one part, a sorted posting list of failing
rows per filter. Unions of lists are galloping k-way merges, what a filter adds to those before it
is a galloping difference, and sizes are summed over the blocks of a part. As a document counts for an order
only through the set of filters before a step, 31 unions settle all orders.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import collected, rows_of, written

BLOCK = 1 << 16         # rows of a block at most
_WORD = r"[^\x20\x09-\x0D]+"
MARKS = ("good", "toxic")


# --- conditions --------------------------------------------------------------------------------

def conditions(text: Column) -> dict[str, Column]:
    """Filters A to D: whether a document fails them. Null texts are empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 50,
            "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
            "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
            "D": F.rlike(text, F.lit("[#$%&*|]"))}


def failing_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 part: str = "source") -> DataFrame:
    """``part, id, tie, fails, marks``: narrow rows, with a bit per filter A to E and per mark.

    E, a text equal to that of a smaller id, is judged on 256-bit digests over the whole table. A null
    id is no smaller id, fails no E and has no label. An id that several rows of ``labels`` name is
    marked if any of them marks it. A null part is the empty string.
    """
    value = F.col(f"`{text}`")
    bits = sum((F.when(found, F.lit(1 << k)).otherwise(F.lit(0))
                for k, found in enumerate(conditions(value).values())), F.lit(0))
    rows = written(docs.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{key}`").alias("id"),
        F.monotonically_increasing_id().alias("tie"), bits.alias("bits"),
        F.unhex(F.sha2(F.coalesce(value, F.lit("")), 256)).alias("digest")), "failing")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")) \
        .filter("n > 1 and first is not null").drop("n")
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0))
         + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("marks")).filter("marks > 0")
    repeats = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return rows.join(first, "digest", "left").select(
        "part", "id", "tie", (F.col("bits") + F.when(repeats, 16).otherwise(0)).alias("fails")) \
        .join(marked, "id", "left").select("part", "id", "tie", "fails", F.coalesce("marks", F.lit(0)).alias("marks"))


# --- posting lists -----------------------------------------------------------------------------

POSTINGS = pa.schema([("part", pa.string()), ("n_rows", pa.int64()), ("ids", pa.list_(pa.int64())),
                      ("failing", pa.list_(pa.list_(pa.int32()))), ("marked", pa.list_(pa.list_(pa.int32())))])


def posting_lists(rows: DataFrame, n_filters: int, n_marks: int = len(MARKS), block: int = BLOCK) -> DataFrame:
    """A row per part and range of ids: ``part, n_rows, ids, failing, marked``.

    ``ids`` are those of the rows that fail anything, in order; ``failing`` has a sorted list of positions
    in ``ids`` per filter and ``marked`` one per mark. Rows that repeat an id are rows of their own. A
    range holds ``block`` rows at most, so a part of any size is many ranges in many tasks.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            part, n, ids, failing, marked = None, 0, [], [], []
            for name, key, fails, marks in rows_of(batches, 4096):
                if name != part or n == block:
                    if n:
                        yield part, n, ids, failing, marked
                    part, n, ids = name, 0, []
                    failing, marked = [[] for _ in range(n_filters)], [[] for _ in range(n_marks)]
                n += 1
                if fails:
                    for lists, bits in ((failing, fails), (marked, marks)):
                        for k, found in enumerate(lists):
                            if bits >> k & 1:
                                found.append(len(ids))
                    ids.append(key)
            if n:
                yield part, n, ids, failing, marked

        yield from collected(blocks(), POSTINGS, width=lambda row: 100 + 24 * len(row[2]))

    return rows.repartitionByRange("part", "id", "tie").sortWithinPartitions("part", "id", "tie") \
        .select("part", "id", "fails", "marks").mapInArrow(
            build, "part string, n_rows bigint, ids array<bigint>, failing array<array<int>>, marked array<array<int>>")


def gallop(ids: list[int], least: int, start: int) -> int:
    """The first position from ``start`` on whose id is at least ``least``: doubled steps, then bisection."""
    step, end = 1, start
    while end < len(ids) and ids[end] < least:
        start, end, step = end + 1, end + step, step * 2
    return bisect_left(ids, least, start, min(end, len(ids)))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted ids that are in any of the sorted ``lists``, copied in runs up to the next other head."""
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        head, k, start = heads[0]
        ids, other = lists[k], min(heads[1:3])[0]
        end = start + 1 if head == other else gallop(ids, other, start + 1)
        if head != other:
            out += ids[start:end]
        if end < len(ids):
            heapreplace(heads, (ids[end], k, end))
        else:
            heappop(heads)
    for _, k, start in heads:
        out += lists[k][start:]
    return out


def n_new(ids: list[int], known: list[int]) -> int:
    """How many of the sorted ``ids`` are not among the sorted ``known``."""
    n, at, i = 0, 0, 0
    while i < len(ids):
        at = gallop(known, ids[i], at)
        if at == len(known):
            return n + len(ids) - i
        if known[at] == ids[i]:
            i += 1
        else:
            end = gallop(ids, known[at], i + 1)
            n, i = n + end - i, end
    return n


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each filter adds to each set of others, for each block: ``part, before, filter, counts``."""
    schema = pa.schema([("part", pa.string()), ("before", pa.int32()), ("filter", pa.int32()),
                        ("n_rows", pa.int64()), ("removed", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def rows():
        for part, n_rows, failing, marked in rows_of(batches, 1):
            universes = [failing] + [[_common(f, m) for f in failing] for m in marked]
            unions = [union([f for k, f in enumerate(failing) if before >> k & 1])
                      for before in range(1 << len(failing))]
            for before, known in enumerate(unions):
                for k in range(len(failing)):
                    if not before >> k & 1:
                        yield (part, before, k, n_rows, *(n_new(lists[k], known) for lists in universes))

    yield from collected(rows(), schema)


def _common(ids: list[int], marked: list[int]) -> list[int]:
    out, at = [], 0
    for x in ids:
        at = gallop(marked, x, at)
        if at == len(marked):
            break
        if marked[at] == x:
            out.append(x)
    return out


# --- orders ------------------------------------------------------------------------------------

def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def audit(postings: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step.

    Columns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``. A part has all rows even if nothing fails; an empty table has no part and gives no row.
    The sums of a part are ``2^(filters - 1) * filters`` rows, however many documents it has.
    """
    n = len(names)
    sums = postings.select("part", "n_rows", "failing", "marked").mapInArrow(
        lambda batches: _added(b.select(["part", "n_rows", "failing", "marked"]) for b in batches),
        "part string, before int, filter int, n_rows bigint, removed bigint, good bigint, toxic bigint") \
        .groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in ("n_rows", "removed", "good", "toxic")])
    code = F.col("before") * n + F.col("filter")
    parts = sums.groupBy("part").agg(
        F.max("n_rows").alias("n_rows"),
        F.map_from_entries(F.collect_list(F.struct(code, F.struct("removed", "good", "toxic")))).alias("sums"))
    steps = []
    for order in permutations(range(n)):
        done, codes = 0, []
        for step, k in enumerate(order, 1):
            codes.append(done * n + k)
            done |= 1 << k
            steps.append({"filter_order": "".join(names[i] for i in order), "step": step, "filter": k,
                          "codes": codes[:], "others": (((1 << n) - 1) & ~(1 << k)) * n + k})
    weights = [[{"code": b * n + k, "weight": factorial(b.bit_count()) * factorial(n - 1 - b.bit_count())}
                for b in range(1 << n) if not b >> k & 1] for k in range(n)]

    def one(code_: Column, field: str) -> Column:
        return F.element_at("sums", code_)[field]

    zero = F.lit(0).cast("long")
    # So many orders have a given set of filters before a filter.
    shapley = F.transform(_constant(weights, "array<array<struct<code int, weight bigint>>>"), lambda sets: F.aggregate(
        sets, zero, lambda total, w: total + w["weight"] * one(w["code"], "removed")))
    s = F.col("s")
    here = F.element_at(s["codes"], -1)
    return parts.select("part", "n_rows", "sums", shapley.alias("shapley")) \
        .select("part", "n_rows", "sums", "shapley", F.explode(_constant(
            steps, "array<struct<filter_order string, step int, filter int, codes array<int>, others int>>")).alias("s")) \
        .select("part", s["filter_order"].alias("filter_order"), s["step"].alias("step"),
                (F.col("n_rows") - F.aggregate(s["codes"], zero, lambda total, c: total + one(c, "removed")))
                .alias("kept"),
                one(here, "removed").alias("removed"),
                (one(s["filter"], "removed") - one(here, "removed")).alias("redundant"),
                one(s["others"], "removed").alias("unique_fails"),
                one(here, "good").alias("good_lost"), one(here, "toxic").alias("toxic_lost"),
                F.get("shapley", s["filter"]).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs`` (``doc_id, text, source``); other columns are not read.

    Empty and null texts fail A, and E if a smaller id has one too. Very long texts are read whole.
    """
    return audit(posting_lists(failing_rows(docs, labels), 5), "ABCDE")
