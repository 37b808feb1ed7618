"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each shard of documents becomes one array of word numbers and its suffix array. Every suffix of the
test items is searched in it by bisection, word by word, which gives the range of training suffixes
that continue like it, hence all verbatim matches and where they stand. Words that no test item has
end a match, so a shard's suffix array holds only suffixes that could match at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ROW, byte_length, hash60, packed, text_of, unpacked, written

WINDOW = 13                 # words of a window
SHARE = 20                  # contaminated: hit words times this reach the words of the document
SHARD_BYTES = 8 << 20       # text of one suffix array
BLOCK_BYTES = 32 << 20      # test text that is sent to the tasks at once
WORDS, MATCHES = "_n_words", "_matches"     # while texts are searched
MATCH = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"

# Bytes of words as they are, A-Z in lower case, all other bytes as blanks.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``codes`` in the order of their suffixes, by prefix doubling up to ``depth``."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth and len(codes) > 1:
        after = np.zeros(len(codes), np.int64)
        after[:-step] = rank[step:]
        pair = rank * (len(codes) + 2) + after
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1])))
        if rank[order[-1]] == len(codes):
            break
        step *= 2
    return order


def _bound(column: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool):
    """Bisection of many ranges at once: first place in [low, high) not before (after) ``wanted``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = column[np.minimum(middle, len(column) - 1)]
        up = open_ & ((at <= wanted) if right else (at < wanted))
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


class TestItems:
    """Test items as one array of word numbers; every word of an item begins a test suffix."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        codes, item, left, place = [], [], [], []
        self.ids = []
        for name, text in items:
            if found := words(text):
                codes += [self.number.setdefault(w, len(self.number) + 1) for w in found]
                item += [len(self.ids)] * len(found)
                place += range(len(found))
                left += range(len(found), 0, -1)
                self.ids.append(name)
        self.codes, self.item, self.place = (np.array(x, np.int64) for x in (codes, item, place))
        left = np.array(left, np.int64)
        size = self.place + left
        self.need = np.minimum(size, window)                # words of the item's windows
        self.starts = np.flatnonzero(left >= self.need)     # suffixes that a window begins
        self.shortest = int(self.need.min()) if len(self.need) else 0

    def occurrences(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (test suffix, training position) whose window matches."""
        suffix = self.starts
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order), np.int64)
        done_suffix, done_low, done_high = [], [], []
        depth = 0
        padded = np.concatenate((text, np.zeros(int(self.need.max()) + 1, np.int64)))
        while len(suffix):
            ready = self.need[suffix] == depth
            for kept, part in ((done_suffix, suffix), (done_low, low), (done_high, high)):
                kept.append(part[ready])
            suffix, low, high = suffix[~ready], low[~ready], high[~ready]
            column, wanted = padded[order + depth], self.codes[suffix + depth]
            low, high = _bound(column, low, high, wanted, False), _bound(column, low, high, wanted, True)
            alive = low < high
            suffix, low, high = suffix[alive], low[alive], high[alive]
            depth += 1
        suffix, low, high = map(np.concatenate, (done_suffix, done_low, done_high))
        counts = high - low
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(suffix, counts), order[np.repeat(low, counts) + inner]


def _shard_matches(items: TestItems, texts: list[str | None]) -> tuple[list[int], list[list[dict]]]:
    """Words and maximal matches (of at least a window) of each document of a shard."""
    get = items.number.get
    coded = [np.array([get(w, 0) for w in words(t)], np.int64) for t in texts]
    n_words = [len(c) for c in coded]
    found: list[list[dict]] = [[] for _ in texts]
    if not items.ids or not sum(n_words):
        return n_words, found
    text = np.concatenate([x for c in coded for x in (c, np.zeros(1, np.int64))])
    begin = np.concatenate(([0], np.cumsum(np.array(n_words) + 1)[:-1]))
    stops = np.flatnonzero(text == 0)
    run = np.diff(np.concatenate(([-1], stops))) - 1        # known words before each stop
    useful = np.repeat(run >= items.shortest, run + 1)      # runs and the stops that end them
    origin = np.flatnonzero(useful)
    if not len(origin):
        return n_words, found
    order = suffix_array(text[origin], int(run.max()) + 1)
    order = order[text[origin][order] > 0]
    suffix, position = items.occurrences(text[origin], order)
    if not len(suffix):
        return n_words, found
    position = origin[position]
    doc = np.searchsorted(begin, position, "right") - 1
    # Windows that follow each other in an item and in a document are one longer match.
    sort = np.lexsort((position, position - suffix, items.item[suffix], doc))
    suffix, position, doc = suffix[sort], position[sort], doc[sort]
    item, line = items.item[suffix], position - suffix
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                            | (line[1:] != line[:-1]) | (position[1:] != position[:-1] + 1)))
    start = np.flatnonzero(first)
    end = np.concatenate((start[1:], [len(first)])) - 1
    for s, e in zip(start.tolist(), end.tolist()):
        d = int(doc[s])
        found[d].append({"item_id": items.ids[item[s]], "item_word": int(items.place[suffix[s]]),
                         "doc_word": int(position[s] - begin[d]),
                         "n_words": int(position[e] - position[s] + items.need[suffix[e]])})
    return n_words, found


def _pieces(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    shard = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                 keep: list[str] | None = None, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns ``keep`` (default all) of each row with ``n_words`` and ``matches``.

    A match is a maximal verbatim run of words that a test item and the document share, at least a
    window long (``window`` words, or a whole shorter item). ``benchmark`` may be of any size: it is
    searched in blocks of a bounded size, each result written before the next block is sent. Null or empty texts have no words;
    items without words match nothing; rows of one item id count as one item; a null item id is "".
    Repeated documents are rows of their own, and every text is searched whole. ``n_words`` and
    ``matches`` must not be names of kept columns here; ``clean`` takes any names.
    """
    return _searched(docs, benchmark, text, window, docs.columns if keep is None else keep, item, item_text) \
        .withColumnsRenamed({WORDS: "n_words", MATCHES: "matches"})


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, window: int, keep: list[str],
              item: str = "item_id", item_text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("id"),
                             F.col(f"`{item_text}`").alias("t")).distinct()
    # An id counts too, so that items of short texts are bounded as well.
    size = named.agg(F.sum(byte_length("t") + byte_length("id"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    if blocks > 1:
        part = F.pmod(hash60(F.concat(text_of("id"), F.coalesce(F.col("t"), F.lit("")))), F.lit(blocks))
        named = written(named.withColumn("part", part), "items")
    found = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])],
                        F.lit(0).cast("long").alias(WORDS), F.array().cast(MATCH).alias(MATCHES))
    for k in range(blocks):
        items = spark.sparkContext.broadcast(
            [(r.id, r.t) for r in (named.filter(F.col("part") == k) if blocks > 1 else named).select("id", "t").collect()])
        names = keep if k == blocks - 1 else list(dict.fromkeys([*keep, text]))
        found = _with_matches(found, items, text, window, names)
        if k < blocks - 1:
            found = written(found, "searched")
            items.destroy()
    return found


def _with_matches(found: DataFrame, items, text: str, window: int, names: list[str]) -> DataFrame:
    schema = found.select(*[F.col(f"`{c}`") for c in names], WORDS, MATCHES).schema
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()),
                               ("doc_word", pa.int32()), ("n_words", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestItems(items.value, window)
        for batch in batches:
            for piece in _pieces(batch, text, SHARD_BYTES):
                n_words, matches = _shard_matches(tests, piece.column(text).to_pylist())
                earlier = piece.column(MATCHES).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in names]
                    + [pa.array(n_words, pa.int64()),
                       pa.array([a + b for a, b in zip(earlier, matches)], kind)],
                    names=[*names, WORDS, MATCHES])

    return found.mapInArrow(search, schema)


def _hit(matches: str) -> Column:
    """Words inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m.doc_word.alias("a"), (m.doc_word + m.n_words).alias("b"))))
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda s, m: F.struct(
            (s.n + F.greatest(m.b - F.greatest(m.a, s.upto), F.lit(0))).alias("n"),
            F.greatest(m.b, s.upto).alias("upto")), lambda s: s.n)


def _contaminated(hit: Column, n_words: Column) -> Column:
    return (hit > 0) & (hit * SHARE >= n_words)


def judge(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` (words inside matches), ``n_items``, ``items_sha256`` and ``contaminated``."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item_id)))
    return found.withColumns({"n_hit": _hit("matches"), "n_items": F.size(items).cast("long"),
                              "items_sha256": F.sha2(F.array_join(items, ","), 256)}) \
        .withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found = _searched(packed(docs, text=F.col(f"`{text}`")), benchmark, "text", WINDOW, [ROW])
    return unpacked(found.filter(~_contaminated(_hit(MATCHES), F.col(WORDS))), docs.columns)
