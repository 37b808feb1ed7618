"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Each shard of vectors holds postings by dimension, cut into segments of equal quantised impact.
Segments are processed by descending impact for a block of queries at once. What is still unknown
about a row is a vector of known length, so its product with a query is bounded; processing stops
when these bounds prove that only few rows can belong to the answer, and those are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import hash60, rows_of, text_of, written

SCALE = 256
STEP = 8                    # least width of an impact level
LEVELS = 128                # of a shard, whatever the size of its components
QUERY_BLOCK = 16_384        # queries that are sent to the tasks at once
SHARD_ROWS = 8_192          # rows of one index
CELLS = 1 << 21             # accumulators held at once
FEW = 32                    # stop when at most one row in FEW (or 4 k rows) is still possible


def integers(vectors: list[list[float]], width: int) -> np.ndarray:
    """floor(256 x) of each component; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors):
        row[:len(vector)] = np.floor(SCALE * np.asarray(vector, np.float64)).astype(np.int64)
    return out


class Index:
    """Postings of a shard: per impact level the (dimension, impact, rows) segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        step = max(STEP, int(np.abs(vectors).max(initial=0)) // LEVELS + 1)
        level = np.abs(vectors) // step
        row, dimension = np.nonzero(level)
        value, sign = level[row, dimension], np.sign(vectors[row, dimension])
        order = np.lexsort((row, dimension, sign, -value))          # all postings, sorted once
        row, dimension, value, sign = row[order], dimension[order], value[order], sign[order]
        impact = sign * (value * step + step // 2).astype(np.float64)
        known = vectors[row, dimension].astype(np.float64)
        gained = known ** 2 - (known - impact) ** 2
        rest = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.segments: list[tuple[int, list[tuple[int, float, np.ndarray]]]] = []
        self.unknown: list[np.ndarray] = []         # length of what is unknown after each level
        for a, b in _runs(value):
            self.segments.append((int(value[a]), [
                (int(dimension[a + c]), float(impact[a + c]), row[a + c:a + d])
                for c, d in _runs(dimension[a:b] * 2 + (sign[a:b] > 0))]))
            rest = rest - np.bincount(row[a:b], gained[a:b], len(ids))
            self.unknown.append(np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9))

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int,
            floor: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """The ``k`` best ``(query id, row id, score)`` of each query within the shard.

        ``floor`` has the ``k``-th best score that each query has found elsewhere; rows below it may be left out.
        """
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        block = int(np.clip(CELLS // max(len(self.ids), 1), 16, 4096))
        for start in range(0, len(queries), block):
            part = slice(start, start + block)
            possible = self._possible(queries[part].astype(np.float64), k, floor[part])
            for q, own, rows in zip(queries[part], query_ids[part].tolist(), possible.T):
                rows = np.flatnonzero(rows)
                rows = rows[self.ids[rows] != own]
                score = self.vectors[rows] @ q
                for r in np.lexsort((self.ids[rows], -score))[:k]:
                    yield own, int(self.ids[rows[r]]), int(score[r])

    def _possible(self, queries: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
        """Whether each row may be among the ``k + 1`` best (the query itself may be one) of each query."""
        n, wanted = len(self.ids), k + 1
        possible = np.ones((n, len(queries)), bool)
        if n <= wanted:
            return possible
        score = np.zeros((n, len(queries)))
        length = np.sqrt((queries ** 2).sum(axis=1)) * (1 + 1e-9)
        for (_, segments), unknown in zip(self.segments, self.unknown):
            for dimension, impact, rows in segments:
                score[rows] += impact * queries[:, dimension]
            bound = unknown[:, None] * length
            least = np.maximum(np.partition(score - bound, n - wanted, axis=0)[n - wanted], floor)
            possible = score + bound >= least - 1e-6 * (1 + np.abs(least))
            if possible.sum(axis=0).max(initial=0) <= max(4 * k, n // FEW):
                break
        return possible


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1 if len(values) else ()
    return zip([0, *edges], [*edges, len(values)]) if len(values) else iter(())


def usable(rows: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(vector).isNotNull()).filter(~bad)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of highest integer inner product per query.

    All rows take part but those of the query's own id; ties go to the smaller id. Vectors that are
    null or hold a null or non-finite component take no part, on either side; vectors of different
    length are compared as if filled up with zeros; components are below 2^20 in size. Null ids take
    no part. Of several query rows of one id the least vector counts; repeated rows are candidates
    each. With fewer rows than ``k`` there are fewer results, with none there is none. Extra columns
    are not read. Queries go to the tasks in blocks of a bounded number.
    """
    spark = rows.sparkSession
    narrow = usable(rows.select(F.col(f"`{key}`").cast("long").alias("id"),
                                F.col(f"`{vector}`").cast("array<double>").alias("v")), "v").filter("id is not null")
    asked = usable(queries.select(F.col(f"`{key}`").cast("long").alias("id"),
                                  F.col(f"`{vector}`").cast("array<double>").alias("v")), "v") \
        .filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    width = max((narrow.agg(F.max(F.size("v"))).first()[0] or 0), 1)
    blocks = 1 + asked.count() // QUERY_BLOCK
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(hash60(text_of("id")), F.lit(blocks)) == b).collect() if blocks > 1 \
            else asked.collect()
        sent = spark.sparkContext.broadcast([(r.id, r.v) for r in part])
        part = _best(narrow, sent, width, k)
        if blocks > 1:                              # tasks and driver hold the queries of one block
            part = written(part, "answers")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _best(rows: DataFrame, queries, width: int, k: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        ids = np.array([i for i, _ in asked], np.int64)
        vectors = integers([v for _, v in asked], max([width, *(len(v) for _, v in asked)]))
        held: list[tuple] = []
        scores = np.full((len(ids), k), -np.inf)        # the best of this task so far, ascending
        place = {i: p for p, i in enumerate(ids.tolist())}

        def answers():
            index = Index(np.array([i for i, _ in held], np.int64),
                          integers([v for _, v in held], vectors.shape[1]))
            best = list(index.top(ids, vectors, k, scores[:, 0]))
            for query, _, score in best:
                mine = scores[place[query]]
                if score > mine[0]:
                    mine[0] = score
                    mine.sort()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*best)] if best else
                                              [pa.array([], pa.int64())] * 3, schema=schema)

        for row in rows_of(batches, 1024):
            held.append(row)
            if len(held) >= SHARD_ROWS:
                yield answers()
                held.clear()
        if held:
            yield answers()

    return rows.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
