"""Near-duplicate documents by MinHash bands and odd sketches.

A document is its set of five-word shingles. Documents of equal sets are one class. Classes that
share a band of MinHash values are candidates; their odd sketches (MinHash samples folded into a
parity bitmap, whose XOR has a bit for each sample that differs) show whether they can be similar,
and the full sets decide. Candidates come in two rounds: first each member of a band with two
members of it picked at random, which joins up most of every group in linear work; then, in blocks,
what still lies in different components. So no link that could change a component stays unseen, and
no group is expanded into rows of pairs: tasks pass on members, and only links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import chunks_of, mixed, rows_of, told_apart, written
from tracewell.llm.components import components

SHINGLE = 5
BANDS, ROWS = 40, 4                 # (1 - 0.75^4)^40 = 3e-7 of the pairs at 0.75 share no band
SAMPLES = BANDS * ROWS
BITS = 1024                         # of an odd sketch
FLOOR = 0.55                        # similarity below which a sketch rules a pair out: 0.75 - 5 sigma
MOST_BITS = int(BITS / 2 * (1 - np.exp(-2 * 2 * SAMPLES * (1 - FLOOR) / BITS)))
NUMERATOR, DENOMINATOR = 75, 100    # linked: 100 * intersection >= 75 * union
BLOCK = 1024                        # members of a band that one step compares with as many others
BEST = 3                            # first-round candidates of a class that are looked at
SALT = 256                          # pairs of one class that are confirmed in a row
CHUNK = 1 << 20                     # bytes of text that are hashed at once

_random = np.random.default_rng(20240607)
_ODD = _random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15          # odd, so that its powers can be inverted modulo 2^64
_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:size], _powers["down"][:size]


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts, and the number of them in each text."""
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    joined = np.frombuffer(b" ".join(w for doc in split for w in doc) + b" ", np.uint8)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _power_tables(len(joined))
    sums = np.cumsum(up * (joined.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    before = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], 0).astype(np.uint64)
    word = mixed((sums[ends] - before) * down[starts])

    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[doc]
    length = np.minimum(counts, SHINGLE)[doc]
    padded = np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    value = length.astype(np.uint64) * _STEP[SHINGLE]
    for k in range(SHINGLE):
        value += np.where(k < length, padded[place + k], 0).astype(np.uint64) * _STEP[k]
    value = mixed(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    kept = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
    return value[kept], np.bincount(doc[kept], minlength=len(texts))


def fingerprints(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit value per set, independent of order; 0 for an empty set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ _STEP[6]), dtype=np.uint64)))
    end = np.cumsum(sizes)
    return np.where(sizes > 0, mixed(total[end] - total[end - sizes] + sizes.astype(np.uint64)), 0)


def signatures(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches (as 64-bit words) of the sets that are not empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    least = np.empty((len(starts), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        least[:, k] = np.minimum.reduceat(values * _ODD[k], starts)
    least = mixed(least ^ _ODD)
    bands = np.zeros((len(starts), BANDS), np.uint64)
    for r in range(ROWS):
        bands += least[:, r::ROWS] * _STEP[r]
    bands = mixed(bands + np.arange(BANDS, dtype=np.uint64) * _STEP[7])
    bit = (least >> np.uint64(54)).astype(np.int64) + np.arange(len(starts))[:, None] * BITS
    parity = (np.bincount(bit.ravel(), minlength=len(starts) * BITS) & 1).astype(np.uint8)
    return bands, np.packbits(parity).view(np.uint64).reshape(len(starts), BITS // 64)


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.where(present, rows.shape[1] if len(rows) else 0, 0))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel().view(np.int64)))


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in chunks_of(rows_of(batches), lambda r: len(r[2] or ""), CHUNK):
        values, sizes = shingle_sets([r[2] for r in rows])
        if sizes.any():
            bands, sketches = signatures(values, sizes)
        else:
            bands, sketches = np.zeros((0, BANDS), np.uint64), np.zeros((0, BITS // 64), np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array(fingerprints(values, sizes).view(np.int64)),
             pa.array(fingerprints(mixed(values + _STEP[5]), sizes).view(np.int64)), pa.array(sizes.astype(np.int64)),
             _lists(bands, sizes > 0), _lists(sketches, sizes > 0)],
            names=["id", "text_key", "node", "check", "n", "bands", "sketch"])


SIGNATURE = "id bigint, text_key bigint, node bigint, check bigint, n bigint, bands array<bigint>, sketch array<bigint>"


def _differing(a: str, b: str) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITS // 64)),
               start=F.lit(0))


def _may_link(n: str, m: str) -> Column:
    """Whether set sizes permit a link at all."""
    return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR


def _first_candidates(entries: DataFrame, reps: DataFrame) -> DataFrame:
    """For each class the likeliest of the pairs with two random members of each of its bands."""
    mixed_key = F.col("node").bitwiseXOR(F.col("band"))
    centres = entries.groupBy("band").agg(F.count("*").alias("size"), F.min(mixed_key).alias("x"),
                                          F.max(mixed_key).alias("y")).filter("size > 1 and x != y") \
        .select("band", F.explode(F.array(F.col("x").bitwiseXOR(F.col("band")),
                                          F.col("y").bitwiseXOR(F.col("band")))).alias("centre"))
    pairs = entries.join(centres, "band").filter("node != centre").select("node", "centre").distinct()
    left = reps.select("node", "n", "sketch")
    right = reps.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    pairs = pairs.join(left, "node").join(right, "centre").filter(_may_link("n", "m")) \
        .select("node", "centre", _differing("sketch", "other").alias("bits")) \
        .filter(F.col("bits") <= MOST_BITS)
    rank = F.row_number().over(W.partitionBy("node").orderBy("bits", "centre"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= BEST).select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


MEMBER = ("band bigint, i int, j int, block int, node bigint, root bigint, n bigint, sketch array<bigint>, "
          "bands array<bigint>, big boolean")
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(),
          pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())


def _blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[list[tuple]]:
    """Lists of rows of equal ``band, i, j`` from rows sorted by them."""
    held: list[tuple] = []
    for row in rows_of(batches, step):
        if held and held[0][:3] != row[:3]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _block_candidates(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers ``k, others`` of pairs in different components that sizes and sketches permit.

    A pair is left to the first band that it shares, so it comes up once in all blocks.
    """
    band, i, j = rows[0][:3]
    block, node, root, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
    sketch = np.array([r[7] for r in rows], np.int64).view(np.uint64)
    bands = np.array([r[8] for r in rows], np.int64)
    big = np.array([r[9] for r in rows])
    _, which, size = np.unique(root, return_inverse=True, return_counts=True)
    done = np.zeros(len(rows), bool)
    for k in np.flatnonzero(which != np.argmax(size)):      # all but the largest component here
        done[k] = True
        others = ~done & (root != root[k]) & (np.minimum(n, n[k]) * DENOMINATOR >= np.maximum(n, n[k]) * NUMERATOR)
        # Members of a band's largest component are met in their own block, others between blocks.
        others &= (block != block[k]) if i != j else (block == block[k]) | big | big[k]
        others = np.flatnonzero(others)
        bits = np.bitwise_count(sketch[others] ^ sketch[k]).sum(axis=1)
        others = others[np.argsort(bits, kind="stable")][:int((bits <= MOST_BITS).sum())]
        if len(others):
            first = np.argmax(bands[others] == bands[k], axis=1)
            others = others[bands[k][first] == band]
        if len(others):
            yield int(k), others


def _members_with_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks (rows sorted by ``band, i, j``) that have a candidate in their block."""
    for rows in _blocks(batches, 1024):
        found = np.zeros(len(rows), bool)
        for k, others in _block_candidates(rows):
            found[k] = True
            found[others] = True
        if found.any():
            kept = [r for r, f in zip(rows, found) if f]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*kept), _KINDS)],
                                             names=[c.split()[0] for c in MEMBER.split(", ")])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    joined = np.concatenate((a, b))
    joined.sort()
    common = int((joined[1:] == joined[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(joined) - common)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components of a block, by full sets; pairs that earlier links join are skipped."""
    for rows in _blocks(batches, 64):
        sets = [shingle_sets([r[10]])[0] for r in rows]
        root = {r[5]: r[5] for r in rows}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for k, others in _block_candidates(rows):
            for o in others.tolist():
                a, b = top(rows[k][5]), top(rows[o][5])
                if a != b and _similar(sets[k], sets[o]):
                    root[a] = b
                    links.append((rows[k][4], rows[o][4]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def _remaining_links(entries: DataFrame, reps: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components that the first round left apart.

    Bands that span several components are compared in blocks: on sketches first, then, for the
    members that sketches leave in question, on the full sets, which travel once per member and block.
    Members of a band's largest component are in one block each; the others, usually few, go to all of them.
    """
    entries = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    bands = entries.groupBy("band", "root").agg(F.count("*").alias("size")).groupBy("band").agg(
        F.sum("size").alias("size"), F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("most")) \
        .filter("roots > 1").drop("roots")
    blocks = F.expr(f"cast((size + {BLOCK - 1}) div {BLOCK} as int)")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def place(i, j):
        return F.struct(i.alias("i"), j.alias("j"))

    places = F.when(F.col("big"), F.array(place(F.col("block"), F.col("block")))).otherwise(F.concat(
        F.transform(every, lambda o: place(F.least("block", o), F.greatest("block", o))),
        F.transform(F.filter(every, lambda o: o != F.col("block")), lambda o: place(o, o))))
    names = [c.split()[0] for c in MEMBER.split(", ")]
    members = entries.join(bands, "band").withColumn("blocks", blocks) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .join(reps.select("node", "n", "sketch", "bands"), "node") \
        .withColumn("big", F.col("root") == F.col("most")).withColumn("at", F.explode(places)) \
        .withColumns({"i": F.col("at.i"), "j": F.col("at.j")}).select(names)
    members = written(members.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
                      .mapInArrow(_members_with_candidates, MEMBER), "members")
    fetched = _fetched(members.select("node").distinct(), reps, texts)
    return members.join(fetched, "node").select(*names, "text").repartition("band", "i", "j") \
        .sortWithinPartitions("band", "i", "j").mapInArrow(_block_links, "a bigint, b bigint").distinct()


def _fetched(nodes: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """One text for each class in ``nodes``."""
    wanted = reps.join(nodes, "node").select("node", "id", "text_key").hint("shuffle_hash")
    return written(texts.join(wanted, (texts.text_key == wanted.text_key) & texts.id.eqNullSafe(wanted.id))
                   .select("node", "text").dropDuplicates(["node"]), "texts")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``a, salt, b``, the text of ``a`` first (null ``b``) -> linked pairs."""
    centre, held, links = None, None, []
    for a, salt, b, text in rows_of(batches):
        if centre != (a, salt):
            centre, held = (a, salt), None
        if b is None:
            held = shingle_sets([text])[0]
            continue
        if _similar(held, shingle_sets([text])[0]):
            links.append((a, b))
        if len(links) >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])
            links = []
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Each class's text is fetched once; a class with many pairs is confirmed in salted groups.
    """
    pairs = written(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    fetched = _fetched(nodes, reps, texts)
    crowded = pairs.groupBy("a").agg(F.expr(f"count(*) div {SALT}").alias("n")).filter("n > 0")
    salted = pairs.join(crowded, "a", "left").withColumn("salt", F.pmod(
        F.xxhash64("b"), F.coalesce("n", F.lit(0)) + 1).cast("int")).drop("n")
    heads = salted.select("a", "salt").distinct().join(
        fetched.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    members = salted.join(fetched.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    return heads.unionByName(members).repartition("a", "salt") \
        .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()) \
        .mapInArrow(_confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are what stands between ASCII white space, with A-Z in lower case. Fewer than five words
    are one shingle; null, empty and blank texts have no shingle and are linked with nothing, their
    component is their own key. ``kept`` marks the smallest key of a component. Keys are whole
    numbers; rows of one key are compared like others (all of them are kept or none); a null key is
    never the smallest, and a component of null keys only has a null id. No text is cut, no band or
    group is capped. Extra columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("text_key"),
                        F.col(f"`{text}`").alias("text"))
    signed = told_apart(written(texts.mapInArrow(_signature_rows, SIGNATURE), "signatures"), "node", "check")
    first = signed.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"))
    reps = written(signed.filter("n > 0").join(first.withColumnRenamed("node", "own"), (
        F.col("node") == F.col("own")) & F.col("id").eqNullSafe(F.col("first"))).drop("own", "first", "check").dropDuplicates(["node"]), "classes")
    entries = written(reps.select("node", F.explode("bands").alias("band")).distinct(), "bands")
    many = entries.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
    entries = written(entries.join(many, "band"), "shared-bands")

    links = written(confirmed(_first_candidates(entries, reps), reps, texts), "links")
    roots = components(links)
    more = written(_remaining_links(entries, reps, roots, texts), "links")
    roots = components(links.unionByName(more))
    classes = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = classes.join(smallest, "root").select("node", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return signed.select("id", "node", "n").join(labels, "node", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
