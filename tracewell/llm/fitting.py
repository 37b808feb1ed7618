"""Ridge regression by partition-summed normal equations, with isotonic calibration out of fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-3                # penalty per labelled row
BINS_PER_UNIT = 512         # raw scores are calibrated in bins of this width, from -1 to 2
PRIOR = 0.5                 # score where nothing is labelled

Expand = Callable[[np.ndarray], np.ndarray]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    expand: Expand
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([PRIOR]))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised and expanded statistics with a constant column."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(x), 1)), self.expand(z)), axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.full(len(x), PRIOR)
        return np.round(np.interp(self.inputs(x) @ self.weights, self.knots, self.levels), 6)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def isotonic(position: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: places and means of the blocks of a rising fit."""
    blocks: list[list[float]] = []
    for p, n, s in zip(position, count, total):
        blocks.append([p * n, n, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x, n, s = np.array(blocks).T
    return x / n, s / n


def fit(rows: DataFrame, width: int, expand: Expand, ridge: float = RIDGE) -> Model:
    """Fits ``y`` on the statistics ``x`` (``width`` numbers) of ``rows`` with a ``fold`` each.

    Every fold is scored by the model of the other folds; on these scores the calibration is fitted.
    Only sums leave the tasks: two moments of each statistic, a matrix of fixed size per fold, and
    counts per score bin. Without rows the model gives a constant.
    """
    stats = rows.agg(*[f(F.col("x")[j]) for j in range(width) for f in (F.avg, F.stddev_pop)]).first()
    if stats[0] is None:
        return Model(np.zeros(width), np.ones(width), expand)
    moments = np.array(stats, float).reshape(width, 2)
    model = Model(moments[:, 0], np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0), expand)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y = model.inputs(_matrix(batch.column("x"))), batch.column("y").to_numpy()
            both = np.concatenate((z, y[:, None]), axis=1)
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold):
                part = both[fold == f]
                found[int(f)] = found.get(int(f), 0) + np.concatenate(
                    (part[:, :-1].T @ part, np.full((1, part.shape[1]), len(part))))
        for f, matrix in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()),
                 pa.array(list(matrix), pa.list_(pa.float64()))], names=["fold", "i", "v"])

    size = model.inputs(np.zeros((1, width))).shape[1] + 1
    summed = rows.select("x", "y", "fold").mapInArrow(sums, "fold int, i int, v array<double>") \
        .groupBy("fold", "i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(size)]).alias("v")).collect()
    folds: dict[int, np.ndarray] = {}
    for r in summed:
        folds.setdefault(r.fold, np.zeros((size, size)))[r.i] = r.v
    whole = sum(folds.values())

    def solved(matrix: np.ndarray) -> np.ndarray:
        gram, rows_ = matrix[:-1, :-1], max(matrix[-1, 0], 1)
        penalty = ridge * rows_ * np.eye(len(gram))
        penalty[0, 0] = 0
        return np.linalg.lstsq(gram + penalty, matrix[:-1, -1], rcond=None)[0]

    other = {f: solved(whole - m) if len(folds) > 1 else solved(whole) for f, m in folds.items()}
    model.weights = solved(whole)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.inputs(_matrix(batch.column("x")))
            fold = batch.column("fold").to_numpy()
            raw = np.array([z[k] @ other[int(f)] for k, f in enumerate(fold)])
            bins = np.round(np.clip(raw, -1, 2) * BINS_PER_UNIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    bins = rows.select("x", "y", "fold").mapInArrow(binned, "bin int, y double").groupBy("bin") \
        .agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array(v, float) for v in zip(
        *((r.bin / BINS_PER_UNIT, r.n, r.s) for r in bins))))
    return model


def scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` and the ``score`` of their statistics ``x``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(model.scores(_matrix(batch.column("x"))))],
                names=[*keep, "score"])

    schema = rows.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.5).alias("score")).schema
    return rows.select(*[F.col(f"`{c}`") for c in keep], "x").mapInArrow(score, schema)
