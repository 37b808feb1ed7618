"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of ``length`` tokens belongs to the reciprocal class ``k = capacity // length``: its bins hold
``k`` pieces, whatever they are, as each fits a slot of ``capacity // k`` tokens. So tasks fill bins
on their own, without looking for room. As documents may be cut, a piece that would leave more than a
small part of its slot empty is cut to the next smaller slot instead, and its rest falls into a far higher
class. Bins that a task can't fill are pooled with those of other tasks by rank, and the few pieces that
then remain are cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import collected, rows_of, written

CAPACITY = 2048
END_ID = 1
SLACK = 64              # a piece stays whole if at most one part in so many of its slot stays empty
LONG_RUN = 500          # characters of a word from which on the slower encoder is the faster one
PART = 1 << 16          # characters that it gets at a time

TASK_SHIFT = 36         # sequence_id: task and number; pooled ones from POOLED on, by class and number
POOLED, CLASS_SHIFT = 1 << 61, 40
LAST = 1 << 62          # those of powers of two


# --- tokens ------------------------------------------------------------------------------------

class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by a byte-level BPE file of ``tokenizers``.

    With a rank file of the same vocabulary, ``tiktoken`` gives the same ids in a fifth of the time. Its merges are
    quadratic in a word, so texts with very long words or blanks go to ``tokenizers``, part by part: such a
    vocabulary splits a text before a blank between two characters that are no white space.
    """

    _cut = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])")
    _long_blank = re.compile(rf"\s{{{LONG_RUN}}}")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer
        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                numbers = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=numbers, special_tokens=special)

    def blob(self, text: str) -> bytes:
        if self.fast and max(map(len, text.split()), default=0) < LONG_RUN and not self._long_blank.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        parts = [self.tokenizer.encode(part, add_special_tokens=False).ids for part in self._parts(text)]
        return b"".join(struct.pack(f"<{len(ids)}I", *ids) for ids in parts)

    def _parts(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = start + PART
            while end < len(text) and not self._cut.match(text, end):
                end = text.find(" ", end + 1)
                end = len(text) if end < 0 else end
            yield text[start:end]
            start = end


# --- pieces ------------------------------------------------------------------------------------

def lengths(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        slot = capacity // (capacity // rest)
        if (slot - rest) * slack > slot:
            slot = capacity // (capacity // rest + 1)
        out.append(min(slot, rest))
        rest -= out[-1]
    return out


_PIECE = [("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("task", pa.int64()), ("class", pa.int64()), ("ordinal", pa.int64()),
          ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row"]


def _pieces(files: tuple, capacity: int, end_id: int, slack: int, with_ids: bool):
    """Cuts the documents of a task into pieces and fills its bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tokens, end = TaskContext.get().partitionId(), Tokens(*files), struct.pack("<I", end_id)
        schema: list[pa.Schema] = []

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                schema[:] = [pa.schema([("doc_id", batch.schema.types[0]), *_PIECE])]
                yield batch

        def pieces() -> Iterator[tuple]:
            bins: dict[int, list[tuple]] = {}
            n_bins = 0
            for number, (key, text) in enumerate(rows_of(typed(), 256)):
                blob = tokens.blob(text or "") + end
                start = 0
                for length in lengths(len(blob) // 4, capacity, slack):
                    ids = blob[4 * start:4 * (start + length)]
                    k = capacity // length
                    held = bins.setdefault(k, [])
                    held.append((key, task << TASK_SHIFT | number, start, length, zlib.crc32(ids), len(blob) // 4,
                                 task, k, len(held), ids))
                    start += length
                    if len(held) == k:
                        offset = 0
                        for piece in bins.pop(k):
                            yield *piece[:-1], task << TASK_SHIFT | n_bins, offset, piece[-1] if with_ids else None
                            offset += piece[3]
                        n_bins += 1
            for held in bins.values():
                for piece in held:
                    yield *piece[:-1], None, None, piece[-1]

        rows = pieces()
        for first in rows:
            yield from collected((r for part in ((first,), rows) for r in part), schema[0],
                                 width=lambda row: 100 + len(row[-1] or b""))

    return run


def _powers_of_two(capacity: int, with_ids: bool):
    """Lays the last pieces end to end and cuts them at full sequences, the rest at powers of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = [], None
        for batch in batches:
            schema = batch.schema
            held += rows_of(iter([batch]))
        if not held:
            return
        names = schema.names
        at = {name: names.index(name) for name in names}
        total = sum(r[at["length"]] for r in held)
        room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length()))
                                                   if total % capacity >> b & 1]
        out, sequence, offset = [], 0, 0
        for r in held:
            ids, start = r[at["ids"]], r[at["start"]]
            while ids:
                length = min(len(ids) // 4, room[sequence] - offset)
                part, ids = ids[:4 * length], ids[4 * length:]
                new = dict(zip(names, r)) | {
                    "start": start, "length": length, "ids_crc32": zlib.crc32(part), "sequence_id": LAST + sequence,
                    "offset": offset, "ids": part if with_ids else None}
                out.append(tuple(new[c] for c in names))
                start, offset = start + length, offset + length
                if offset == room[sequence]:
                    sequence, offset = sequence + 1, 0
        yield from collected(iter(out), schema)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id",
         text: str = "text", slack: int = SLACK, with_ids: bool = False, ranks: str | None = None,
         pattern: str | None = None) -> DataFrame:
    """A row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, row``.

    ``tokenizer`` is the file of a byte-level BPE, readable on all executors; ``ranks`` and ``pattern`` are its rank
    file and its splitting expression, for speed. ``capacity`` is a power of two. Every document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Rows that repeat an id, and rows
    without one, are documents of their own, told apart by ``row``. Texts are read whole, however long; other
    columns are not read; an empty table gives no row. Pieces of a sequence lie end to end from offset 0.
    With ``with_ids`` the ids of a piece follow as little-endian 32-bit bytes (see ``sequences``).
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, " \
             "task bigint, class bigint, ordinal bigint, sequence_id bigint, offset bigint, ids binary"
    rows = written(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
                   .mapInArrow(_pieces((tokenizer, ranks, pattern), capacity, end_id, slack, with_ids), schema), "pieces")
    # Ranks of what tasks could not place: a task counts only its own, so only counts are added up. The
    # window has a row per class and task.
    left = rows.filter("sequence_id is null")
    by_class = Window.partitionBy("class")
    counts = left.groupBy("class", "task").agg(F.count("*").alias("n")).select(
        "class", "task", F.sum("n").over(by_class).alias("total"),
        (F.sum("n").over(by_class.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = written(left.join(counts, ["class", "task"]).withColumn("rank", F.col("before") + F.col("ordinal"))
                     .withColumn("filled", F.col("rank") < F.col("total") - F.col("total") % F.col("class"))
                     .drop("before", "total"), "ranked")
    bin_ = F.expr("rank div class")
    pooled = ranked.filter("filled") \
        .withColumn("sequence_id", F.lit(POOLED) + F.shiftleft(F.col("class"), CLASS_SHIFT) + bin_) \
        .withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("rank")
                                                   .rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    # Less than a bin of each class is left, in all tasks together.
    last = ranked.filter("not filled").repartition(1).sortWithinPartitions("class", "rank").select(rows.columns) \
        .mapInArrow(_powers_of_two(capacity, with_ids), schema)
    ids = ["ids"] if with_ids else []
    parts = [rows.filter("sequence_id is not null"), pooled, last]
    placed = [p.select(F.col("doc_id").alias(key), *_COLUMNS, *ids) for p in parts]
    return placed[0].unionByName(placed[1]).unionByName(placed[2])


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, n_tokens, padding, tokens`` of pieces with ids; ``tokens`` are 32-bit bytes.

    A sequence whose length is a power of two stays as it is, others are padded to ``capacity``.
    """
    tokens = F.aggregate(F.sort_array("parts"), F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    n = F.col("n_tokens")
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.collect_list(F.struct("offset", "ids")).alias("parts")).select(
        "sequence_id", "n_tokens",
        F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(capacity) - n).cast("long").alias("padding"),
        tokens.alias("tokens"))
