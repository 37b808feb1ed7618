"""Quality classifier on document statistics.

Random Fourier features of the standardised statistics approximate a Gaussian kernel; ridge scores
come from normal equations summed per partition, and isotonic calibration makes them probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ROW, held_out_fold, packed, rows_of, unpacked, written
from tracewell.llm.fitting import Model, fit, scored

PAIRS = 64              # cosine and sine pairs of random features
BANDWIDTH = 4.0         # of the Gaussian kernel, in standard deviations of the statistics
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3            # scores from here on are accepted
BATCH = 2048

_DOUBLED = re.compile(rb"([!-/:-@\[-`{-~])\1")
_CLASS = np.zeros(256, np.int64)
for _name, _members in enumerate(
        (range(65, 91), range(97, 123), range(48, 58), (32, 9, 10, 11, 12, 13),
         b".?!", b",;:", b"|#$%&*+<=>@\\^_`~{}[]", b"\"'()-/", range(128, 256)), 1):
    _CLASS[list(_members)] = _name
WIDTH = 23

_random = np.random.default_rng(11)
_W = _random.normal(size=(WIDTH, PAIRS)) / BANDWIDTH


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features: inner products approximate exp(-|a - b|^2 / (2 bandwidth^2))."""
    angle = z @ _W
    return np.concatenate((np.cos(angle), np.sin(angle)), axis=1) / np.sqrt(PAIRS)


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, whatever its language; zeros for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * WIDTH
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit, blank, stop, comma, sign, other, high = np.bincount(
        _CLASS, weights=counts, minlength=10)[1:].tolist()
    size = len(raw)
    share = counts[counts > 0] / size
    words = raw.split()
    n = max(len(words), 1)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(upper + lower + high, 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(size), np.log1p(len(words)), lengths.mean(), lengths.std(), (lengths <= 3).mean(),
        upper / letters, high / letters, digit / size, blank / size, stop / n, comma / n, sign / n,
        other / n, len(_DOUBLED.findall(raw)) / n, -float((share * np.log(share)).sum()),
        len(seen) / n, np.log1p(len(seen)) / np.log1p(n), max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1),
        sum(len(w) == 1 and not w.isalnum() and w < b"\x80" for w in words) / n]


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            x = [statistics(t) for (t,) in rows_of(iter([part.select(["_text"])]))]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in part.schema.names[:-1]] + [pa.array(x, pa.list_(pa.float64()))],
                names=[*part.schema.names[:-1], "x"])


def with_statistics(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = rows.drop("_text").withColumn("x", F.array().cast("array<double>")).schema
    return rows.mapInArrow(_statistics_rows, schema)


def labelled(rows: DataFrame, labels: DataFrame, label: str, key: str, folds: int, held_out: int) -> DataFrame:
    """``x, y, fold`` of the labelled rows that are not held out; null labels are none."""
    fold = F.pmod(F.crc32(F.col("_key").cast("string").cast("binary")), F.lit(folds)).cast("int")
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("y")) \
        .filter("y is not null and _key is not null").dropDuplicates(["_key"]) \
        .withColumn("fold", fold).filter(F.col("fold") != held_out)
    return rows.join(marked, F.col(f"`{key}`") == F.col("_key")).select("x", "y", "fold")


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """The classifier of all labelled rows outside the held-out fold; ``rows`` has ``key`` and ``x``."""
    return fit(written(labelled(rows, labels, label, key, FOLDS, HELD_OUT), "labelled"), WIDTH, fourier)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of each row of ``docs``.

    The score rests on the text alone. Null and empty texts have statistics of zero and get a score
    too; a null key is not held out and has no label; a key with several labels counts once; without
    labels all scores are 0.5. Repeated rows get equal scores; extra columns are not read.
    """
    rows = written(with_statistics(docs, [key], text), "statistics")
    return scored(rows, train(rows, labels, key=key), [key]).select(
        key, held_out_fold(key, FOLDS, HELD_OUT).alias("held_out"), "score", accepted().alias("predicted"))


def accepted() -> Column:
    return (F.col("score") >= ACCEPT).cast("int")


def keep_accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns, whatever their names.

    Statistics are made once, and written beside the rows.
    """
    own = packed(docs, key=F.col(f"`{key}`"), text=F.col(f"`{text}`"))
    rows = written(with_statistics(own, [ROW, "key"], "text"), "statistics")
    model = train(rows.select("key", "x"), labels.select(F.col(f"`{key}`").alias("key"), "quality"), key="key")
    return unpacked(scored(rows, model, [ROW]).filter(accepted() == 1), docs.columns)
