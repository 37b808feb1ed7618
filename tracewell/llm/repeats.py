"""Exact repeats of at least ``LENGTH`` bytes, by grouping anchors and sorting their contexts.

This stands in for merged Burrows-Wheeler transforms; no transform is made. Only suffixes at anchors are sorted. An anchor is the least hashed gram of a window of ``LENGTH``
bytes, so equal windows have equal anchors at equal places, and about one position in eighty is one.
Each shard of documents lists its anchors; anchors with equal surroundings are settled by counting.
The rest meet by anchor, and the orders of all shards are merged: the interleave of their suffixes is
refined symbol by symbol (eight bytes each), only inside blocks that still agree, which also yields
the common prefixes of neighbours. The same is done for what precedes the anchors, read backwards. A window around an anchor repeats where an interval of common right
context and one of common left context, together as long as the window, share two members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import chunks_of, mixed, rows_of, told_apart, written
from tracewell.llm.near_dedup import _power_tables

LENGTH = 200                    # bytes of a repeat
GRAM = 40                       # bytes of an anchor
REACH = LENGTH - GRAM + 1       # grams in a window, hence the most that a window begins before its anchor
PLACE_BITS = 20
PIECE = 1 << 19                 # window starts of a text that are hashed at once
CHUNK = 4 << 20                 # bytes of text whose anchors are counted before the shuffle
MERGE = 20_000                  # contexts merged at once; an anchor with more is counted by windows
_TAIL = np.uint64(0xD6E8FEB86659FD93)

Spans = list[tuple[int, int]]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up[:-1] * (raw.astype(np.uint64) + np.uint64(1)), dtype=np.uint64, out=sums[1:])
    return sums, down


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``key, context, place, first, last``: window starts ``first..last`` have that anchor."""
    for base in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        part = np.frombuffer(raw, np.uint8)[base:base + PIECE + LENGTH - 1]
        sums, down = _prefix_sums(part)
        grams = len(part) - GRAM + 1
        hashed = mixed((sums[GRAM:] - sums[:grams]) * down[:grams])
        ranked = (hashed >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(grams, dtype=np.uint64)
        place = (_sliding_min(ranked, REACH) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        place = place[first]
        context = mixed((sums[last + LENGTH] - sums[first]) * down[first]
                        + (last - first + 1).astype(np.uint64) * _TAIL)
        yield hashed[place], context, place + base, first + base, last + base


def window_hashes(raw: bytes, first: int, last: int) -> np.ndarray:
    """Two 64-bit hashes of each window that starts in ``first..last``."""
    part = np.frombuffer(raw, np.uint8)[first:last + LENGTH]
    found = []
    for values in (part, part[::-1]):
        sums, down = _prefix_sums(values)
        count = len(part) - LENGTH + 1
        found.append(mixed((sums[LENGTH:] - sums[:count]) * down[:count]))
    return np.stack((found[0], found[1][::-1]), axis=1)


ANCHOR = "route bigint, key bigint, context bigint, row bigint, place int, first int, last int, copies int"
_NAMES = [c.split()[0] for c in ANCHOR.split(", ")]


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a shard. Equal surroundings within a chunk go on once, the others are settled here."""
    for rows in chunks_of(rows_of(batches), lambda r: len(r[1] or ""), CHUNK):
        parts = []
        for row, text in rows:
            for arrays in anchors(_encoded(text)):
                parts.append((*arrays, np.full(len(arrays[0]), row, np.int64)))
        if not parts:
            continue
        key, context, place, first, last, row = map(np.concatenate, zip(*parts))
        order = np.lexsort((context, key))
        key, context, place, first, last, row = (x[order] for x in (key, context, place, first, last, row))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])))
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
        copies = np.where(new, np.minimum(np.repeat(size, size), 2), 0)
        route = np.where(copies > 0, key.view(np.int64), row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in (
                (route, pa.int64()), (key.view(np.int64), pa.int64()), (context.view(np.int64), pa.int64()),
                (row, pa.int64()), (place, pa.int32()), (first, pa.int32()), (last, pa.int32()),
                (copies, pa.int32()))], names=_NAMES)


FOUND = "row bigint, first int, last int, key bigint, place int, settled boolean"
_FOUND = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                    ("key", pa.int64()), ("place", pa.int32()), ("settled", pa.bool_())])


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From rows sorted by ``route, key, context``: window starts that surely repeat (null ``key``), and
    one anchor for each of several surroundings that an anchor has."""
    key = context = head = None
    weight, several = 0, False

    def ended():
        if head is not None and several:
            yield head[3], head[5], head[6], head[1], head[4], weight > 1

    for row in rows_of(batches, 4096):
        _, k, c, doc, _, first, last, copies = row
        if copies == 0:
            yield doc, first, last, None, None, True
            continue
        if k != key:
            yield from ended()
            key, context, head, weight, several = k, c, row, copies, False
        elif c != context:
            several = True
            yield from ended()
            context, head, weight = c, row, copies
        else:
            if weight == 1:
                yield head[3], head[5], head[6], None, None, True
            weight += copies
            yield doc, first, last, None, None, True
            continue
        if copies > 1:
            yield doc, first, last, None, None, True
    yield from ended()


def _classified_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in _classified(batches):
        held.append(row)
        if len(held) >= 50_000:
            yield _found_batch(held)
            held = []
    if held:
        yield _found_batch(held)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, f.type) for v, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


# --- merging -----------------------------------------------------------------------------------

def interleave(block: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes and common prefixes of neighbours, by refining an interleave.

    ``block`` keeps apart suffixes that need no order; ``text`` has a suffix in each row of bytes. In
    each step the blocks whose members agree so far are split by the next eight bytes, all others stay
    as they are. ``common[r]`` belongs to ranks r - 1 and r: 0 between blocks, the width if equal.
    """
    symbols = text.view(">u8").astype(np.uint64)
    order = np.argsort(block, kind="stable")
    sorted_ = block[order]
    common = np.full(len(block) + 1, -1, np.int64)
    common[:-1][np.concatenate(([True], sorted_[1:] != sorted_[:-1]))] = 0
    common[-1] = 0
    for step in range(symbols.shape[1]):
        tied = np.flatnonzero((common[:-1] < 0) | (common[1:] < 0))
        if not len(tied):
            break
        part = np.cumsum(common[:-1] >= 0)[tied]
        symbol = symbols[order[tied], step]
        sort = np.lexsort((symbol, part))
        order[tied], symbol = order[tied][sort], symbol[sort]
        split = (part[1:] == part[:-1]) & (symbol[1:] != symbol[:-1])
        apart = symbol[1:][split] ^ symbol[:-1][split]
        same = sum((apart >> np.uint64(8 * (7 - j)) == 0).astype(np.int64) for j in range(8))
        common[tied[1:][split]] = 8 * step + same
    common[common < 0] = text.shape[1]
    return order, common[:-1]


def repeated_windows(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray,
                     high: np.ndarray) -> np.ndarray:
    """For each suffix and each offset 0..REACH - 1 whether the window that begins so far before the
    anchor occurs in another suffix too. Offsets ``low..high`` belong to a suffix; ``left`` is read backwards."""
    size = len(group)
    orders = [interleave(group, right), interleave(group, left)]
    ranks = []
    for order, _ in orders:
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        ranks.append(rank)
    found = np.zeros((size, REACH), bool)
    for offset in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= offset) & (offset <= high))
        after = np.cumsum(orders[0][1] < LENGTH - offset)[ranks[0][own]]
        pair = after
        if offset:
            pair = after * (size + 1) + np.cumsum(orders[1][1] < offset)[ranks[1][own]]
        sort = np.argsort(pair, kind="stable")
        equal = pair[sort][1:] == pair[sort][:-1]
        found[own[sort[1:][equal]], offset] = True
        found[own[sort[:-1][equal]], offset] = True
    return found


CONTEXT = "key bigint, row bigint, place int, low int, high int, settled boolean, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("place", pa.int32()), ("low", pa.int32()),
                        ("high", pa.int32()), ("settled", pa.bool_()), ("before", pa.binary()),
                        ("after", pa.binary())])
    held = []
    for row, text, open_ in rows_of(batches):
        raw = _encoded(text)
        for x in open_:
            low, high = x["place"] - x["last"], x["place"] - x["first"]
            held.append((x["key"], row, x["place"], low, high, x["settled"],
                         raw[x["first"]:x["place"]][::-1], raw[x["place"]:x["last"] + LENGTH]))
        if len(held) >= MERGE:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, text, open_ in rows_of(batches):
        raw = _encoded(text)
        for x in open_:
            hashes = window_hashes(raw, x["first"], x["last"]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([row] * len(hashes), pa.int64()),
                 pa.array(range(x["first"], x["last"] + 1), pa.int32())], names=["h", "i", "row", "first"])


def _whole_groups(rows: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    """Lists of rows of whole groups (first column), of about ``limit`` rows."""
    held: list[tuple] = []
    for row in rows:
        if len(held) >= limit and row[0] != held[-1][0]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _padded(parts: tuple[bytes, ...], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key`` -> window starts that repeat, as runs ``row, first, last``."""
    for rows in _whole_groups(rows_of(batches, 1024), MERGE):
        key, row, place, low, high, settled, before, after = zip(*rows)
        key, row, place, low, high = (np.array(x, np.int64) for x in (key, row, place, low, high))
        group = np.unique(key, return_inverse=True)[1]
        found = repeated_windows(group, _padded(before, REACH), _padded(after, LENGTH), low, high)
        found[np.array(settled)] = False
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        which, start = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[which]), pa.array(place[which] - end, pa.int32()),
             pa.array(place[which] - start, pa.int32())], names=["row", "first", "last"])


def repeated_starts(texts: DataFrame) -> DataFrame:
    """Runs ``row, first, last`` of window starts whose ``LENGTH`` bytes start anywhere else as well.

    ``texts`` has ``row`` (a number of its own for each row) and ``text``.
    """
    found = written(texts.mapInArrow(_anchor_rows, ANCHOR).repartition("route")
                    .sortWithinPartitions("route", "key", "context")
                    .mapInArrow(_classified_batches, FOUND), "anchors")
    runs = ["row", "first", "last"]
    open_ = found.filter("key is not null")
    hot = written(open_.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MERGE).select("key"), "hot")

    def by_text(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("row").agg(F.collect_list(
            F.struct("key", "place", "first", "last", "settled")).alias("open"))
        return texts.join(lists.hint("shuffle_hash"), "row").select("row", "text", "open")

    some_hot = not hot.isEmpty()
    few = open_.join(hot, "key", "left_anti") if some_hot else open_
    merged = by_text(few).mapInArrow(_contexts, CONTEXT).repartition("key").sortWithinPartitions("key") \
        .mapInArrow(_merged, "row bigint, first int, last int")
    found = found.filter("key is null").select(runs).unionByName(merged)
    if some_hot:
        windows = by_text(open_.join(hot, "key", "left_semi")).mapInArrow(
            _windows, "h bigint, i bigint, row bigint, first int")
        twice = windows.groupBy("h", "i").agg(F.count("*").alias("n")).filter("n > 1").select("h", "i")
        found = found.unionByName(windows.join(twice, ["h", "i"]).select(
            "row", "first", F.col("first").alias("last")))
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names[:-2]
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            out = []
            for text, runs in rows_of(iter([part.select(["_text", "_runs"])])):
                raw, spans = _encoded(text), []
                for first, last in sorted((r["first"], r["last"]) for r in runs or ()):
                    if spans and first <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], last + LENGTH))
                    else:
                        spans.append((first, last + LENGTH))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names] + [pa.array(v, t) for v, t in zip(zip(*out), kinds)],
                names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes covers it that starts at another place too, in this or
    another row, overlapping or not. Texts are taken as UTF-8; null is empty; shorter texts lose
    nothing; copies and repeated rows lose all bytes if long enough, none is spared. ``spans`` are the
    maximal removed runs. Null keys are keys like others; extra columns are not read.
    """
    own, value = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = told_apart(docs.select(own.alias("key"), value.alias("text"), F.xxhash64(own, value).alias("row"),
                                  F.xxhash64(value, F.lit(1), own).alias("check")), "row", "check").drop("check")
    long = rows.filter(F.octet_length("text") >= LENGTH).select("row", "text")
    # Rows that repeat id and text lose all of it; one of them is enough for the search of the others.
    copies = written(long.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"), "copies")
    whole = None
    if not copies.isEmpty():
        one = written(long.join(copies, "row", "left_semi").dropDuplicates(["row"]), "copied")
        long = long.join(copies, "row", "left_anti").unionByName(one)
        whole = one.select("row", F.lit(0).alias("first"), (F.octet_length("text") - LENGTH).alias("last"))
    found = repeated_starts(long).distinct()
    runs = (found if whole is None else found.unionByName(whole)).groupBy("row").agg(
        F.collect_list(F.struct("first", "last")).alias("_runs"))
    rows = rows.select(F.col("key").alias(key), F.col("row").alias("_row"), F.col("text").alias("_text")) \
        .join(runs.hint("shuffle_hash").withColumnRenamed("row", "_row"), "_row", "left") \
        .select(key, "_text", "_runs")
    schema = rows.select(key, *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")],
                         F.lit("").alias("kept_sha256"),
                         F.array().cast("array<struct<start:int,end:int>>").alias("spans")).schema
    return rows.mapInArrow(_removed, schema)
