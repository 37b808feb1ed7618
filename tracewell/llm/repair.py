"""Repair of conversation structure: the cheapest edits that give legal roles, and the least of them.

The rows of a conversation and the states of its role automaton (start, s, u, a) are nodes; the edits Keep,
Rerole, Delete and Insert are arcs. A cost pass leaves the arcs of cheapest edits. These are ranked by
the letters of the audit they begin: first by one letter, then by two, four and so on, each time from the ranks of
half the length and through doubled pointers. The least arc of the entry is the least audit, and the doubled pointers
give all its letters at once.

Rows are dealt by ranges and cut into segments of bounded rows and bytes, so a conversation of any size is many
segments. Costs over a segment are a table of four states by four, and segments meet in
streams of such tables, of 16 numbers per segment; everything else happens within one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import collected, rows_of, written

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 8 << 20
ROWS_AT_ONCE = 1 << 16          # rows whose nodes are in memory together
TASK_SHIFT = 32
_WHITE = " \t\n\x0b\x0c\r"

#: Kinds of rows: class of the role's initial, plus 4 if truncated; MUST for rows that have to go.
CLASSES = {"s": 1, "u": 2, "a": 3}
MUST = 8
BLANK, TRUNCATED = 4, 8                                 # bits of a code beside the class
DELETE, INSERT, RECAST, CUT_SHORT = 2, 5, 1, 5          # costs
INF = 1 << 40

START, S, U, A = range(4)
ENDS = np.array([0, 2 * INSERT, INSERT, 0])             # cost from a state to a legal end without rows
LAST_INSERTS = {START: (), S: ("user", "assistant"), U: ("assistant",), A: ()}
_NEXT = np.array([U, U, A, U])                          # by inserting or recasting
_KEEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
_KEEP_NEXT = np.zeros((MUST + 1, 4), np.int64)
_KEEP_COST = np.full((MUST + 1, 4), INF)
_RECAST_COST = np.full((MUST + 1, 4), INF)
for _kind in range(MUST):
    _RECAST_COST[_kind] = RECAST + (CUT_SHORT if _kind >= 4 else 0)
    for (_state, _initial), _then in _KEEP.items():
        if CLASSES[_initial] == _kind % 4:
            _KEEP_NEXT[_kind, _state] = _then
            _KEEP_COST[_kind, _state] = CUT_SHORT if _kind >= 4 else 0
_LETTERS = np.frombuffer(b"DIKR", np.uint8)


# --- a set of segments at once -----------------------------------------------------------------

class Nodes:
    """Nodes of segments laid end to end: each has a row of four states per row and one more at its end."""

    def __init__(self, kinds: list[bytes], exits: np.ndarray):
        self.sizes = np.array([len(k) for k in kinds], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])).astype(np.int64)
        self.kinds = np.frombuffer(b"".join(k + b"\x08" for k in kinds), np.uint8)
        self.costs = np.zeros((len(self.kinds), 4), np.int64)
        self.costs[self.starts + self.sizes] = exits
        order = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[order]
        for back in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            active = order[:np.searchsorted(-sizes, -back, side="right")]
            at = self.starts[active] + self.sizes[active] - back
            kind, later = self.kinds[at], self.costs[at + 1]
            cost = np.minimum(later + DELETE, _KEEP_COST[kind] + np.take_along_axis(later, _KEEP_NEXT[kind], 1))
            cost = np.minimum(cost, _RECAST_COST[kind] + later[:, _NEXT])
            for _ in range(3):
                cost = np.minimum(cost, INSERT + cost[:, _NEXT])
            self.costs[at] = cost

    @property
    def entries(self) -> np.ndarray:
        return self.costs[self.starts]

    def rank(self) -> None:
        """Ranks the arcs of cheapest edits by the audits that begin with them."""
        n = len(self.costs)
        inner = np.ones(n, bool)
        inner[self.starts + self.sizes] = False
        later = np.concatenate((self.costs[1:], self.costs[:1]))
        here = np.arange(n)[:, None]
        options = (                                                     # in the order of their letters
            (later + DELETE, (here + 1) * 4 + np.arange(4)),
            (self.costs[:, _NEXT] + INSERT, here * 4 + _NEXT),
            (np.take_along_axis(later, _KEEP_NEXT[self.kinds], 1) + _KEEP_COST[self.kinds],
             (here + 1) * 4 + _KEEP_NEXT[self.kinds]),
            (later[:, _NEXT] + _RECAST_COST[self.kinds], (here + 1) * 4 + _NEXT))
        cheapest = np.stack([(cost == self.costs) & inner[:, None] for cost, _ in options], axis=2).reshape(n * 4, 4)
        self.source, self.letter = np.nonzero(cheapest)
        self.target = np.stack([np.broadcast_to(t, (n, 4)) for _, t in options], axis=2).reshape(n * 4, 4)[cheapest]
        # Arcs of a node have different letters, so the first one begins the least audit from there.
        self.none = len(self.source)
        self.first = np.full(n * 4, self.none)
        self.first[self.source[::-1]] = np.arange(self.none)[::-1]
        ranks = np.append(self.letter + 1, 0)
        self.pointers = [np.append(self.first[self.target], self.none)]
        while (self.pointers[-1] != self.none).any():
            ahead = self.pointers[-1]
            ranks = np.unique(ranks * (ranks.max() + 1) + ranks[ahead], return_inverse=True)[1]
            self.pointers.append(ahead[ahead])
        self.ranks = ranks

    def _entry_arcs(self, states: np.ndarray) -> np.ndarray:
        """The arc of the least rank among those that leave each segment's entry."""
        node = self.starts * 4 + states
        best = self.first[node]
        for step in range(1, 4):
            arc = np.minimum(self.first[node] + step, self.none)
            same = (arc < self.none) & (np.append(self.source, -1)[arc] == node)
            best = np.where(same & (self.ranks[arc] < self.ranks[best]), arc, best)
        return best

    def _walk(self, arc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last arcs of the least paths, and the lengths of these."""
        size = np.zeros(len(arc), np.int64)
        for bit in reversed(range(len(self.pointers))):
            ahead = self.pointers[bit][arc]
            go = ahead != self.none
            size += np.where(go, 1 << bit, 0)
            arc = np.where(go, ahead, arc)
        return arc, size + (arc != self.none)

    def exit_states(self, states: np.ndarray) -> np.ndarray:
        last, _ = self._walk(self._entry_arcs(states))
        if not self.none:
            return states
        return np.where(last == self.none, states, self.target[np.minimum(last, self.none - 1)] % 4)

    def paths(self, states: np.ndarray) -> Iterator[tuple[bytes, list[int], list[int]]]:
        """Per segment: letters of the least audit, the row at each, and the state after each."""
        first = self._entry_arcs(states)
        _, sizes = self._walk(first)
        ends = np.cumsum(sizes)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        arc = np.repeat(first, sizes)
        for bit, pointer in enumerate(self.pointers):
            arc = np.where(step >> bit & 1, pointer[arc], arc)
        letters = _LETTERS[self.letter[arc]].tobytes() if len(arc) else b""
        rows = (self.source[arc] // 4 - np.repeat(self.starts, sizes)).tolist() if len(arc) else []
        after = (self.target[arc] % 4).tolist() if len(arc) else []
        for end, size in zip(ends.tolist(), sizes.tolist()):
            yield letters[end - size:end], rows[end - size:end], after[end - size:end]


def kinds_of(codes: bytes, repeated: list[bool]) -> bytes:
    return bytes(MUST if code & BLANK or again else code & 3 | (4 if code & TRUNCATED else 0)
                 for code, again in zip(codes, repeated))


def table_of(kinds: list[bytes]) -> np.ndarray:
    """Costs from each entry state to each exit state, for each segment."""
    out = np.full((len(kinds), 4, 4), INF)
    for state in range(4):
        exits = np.full((len(kinds), 4), INF)
        exits[:, state] = 0
        out[:, :, state] = Nodes(kinds, exits).entries
    return np.minimum(out, INF)


# --- rows and segments -------------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that the crc32 of ``conv_id:turn`` decides.

    Nulls are one blank in that key, in roles and in texts.
    """
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")) \
        .otherwise(F.col("text"))
    times = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate")) \
        .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


_SEGMENT = ("conv_id {kind}, segment bigint, edge boolean, first_turn bigint, last_turn bigint, n_turns bigint, "
            "codes binary, roles array<string>, texts array<string>")


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as segments; ``edge`` marks those of conversations that may have others elsewhere."""
    task = TaskContext.get().partitionId()
    kind: list[pa.DataType] = []

    def typed():
        for batch in batches:
            kind[:] = [batch.schema.types[0]]
            yield batch

    def segments():
        number, held, size, cut = 0, [], 0, True            # the first conversation may begin elsewhere

        def closed(edge: bool) -> tuple:
            turns = [r[1] for r in held if r[1] is not None]
            return (held[0][0], task << TASK_SHIFT | number, edge, turns[0] if turns else None,
                    turns[-1] if turns else None, len(set(turns)), bytes(r[4] for r in held),
                    [r[2] for r in held], [r[3] for r in held])

        for row in rows_of(typed(), 1024):
            if held and (row[0] != held[0][0] or len(held) == SEGMENT_ROWS or size >= SEGMENT_BYTES):
                same = row[0] == held[0][0]
                yield closed(cut or same)
                number, held, size, cut = number + 1, [], 0, same
            held.append(row)
            size += len(row[3])
        if held:
            yield closed(True)

    rows = segments()
    for first in rows:
        schema = pa.schema([("conv_id", kind[0]), ("segment", pa.int64()), ("edge", pa.bool_()),
                            ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64()),
                            ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
        yield from collected((r for part in ((first,), rows) for r in part), schema,
                             width=lambda row: 200 + sum(map(len, row[8])) + 20 * len(row[7]))


def segments_of(rows: DataFrame) -> DataFrame:
    """A row per segment: at most ``SEGMENT_ROWS`` rows of a conversation, in order of turn (nulls first).

    Rows of one turn are ordered by role and by the SHA-256 of the text. Segments of a
    conversation are in order of ``segment``, wherever they are.
    """
    white = f"[^{_WHITE}]"
    trimmed = F.rtrim("text", F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0) \
        + F.when(~F.rlike("text", F.lit(white)), BLANK).otherwise(0) \
        + F.when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest", "tie"]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", code.alias("code"),
                       F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("tie")) \
        .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "code") \
        .mapInArrow(_segment_rows, _SEGMENT.format(kind=kind))


# --- results of conversations ------------------------------------------------------------------

RESULT = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()


class _Conversation:
    """Sums up the segments of one conversation in their order."""

    def __init__(self, key):
        self.key, self.sums, self.cost = key, [0, 0, 0, 0], 0
        self.first_turn = self.last_turn = self.last_class = None
        self.n_turns, self.audit, self.state = 0, [], START
        self.hash, self.lines = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def add(self, first_turn, last_turn, n_turns, codes: bytes, roles, texts, kinds: bytes, path) -> None:
        if first_turn is not None:
            self.n_turns += n_turns - (first_turn == self.last_turn)
            self.first_turn = first_turn if self.first_turn is None else self.first_turn
            self.last_turn = last_turn
        blank = sum(c & BLANK > 0 for c in codes)
        self.sums[0] += blank
        self.sums[1] += kinds.count(MUST) - blank
        self.sums[2] += sum(4 <= k < MUST for k in kinds)
        classes = [c & 3 for c in codes]
        pairs = list(zip(classes, classes[1:]))
        if self.last_class is not None:
            pairs.append((self.last_class, classes[0]))
        self.sums[3] += sum(p not in _LEGAL for p in pairs)
        self.last_class = classes[-1]
        letters, rows, after = path
        self.audit.append(letters.decode())
        for letter, row, state in zip(letters, rows, after):
            if letter == 75:                                                    # K
                self._line(roles[row], texts[row])
                self.cost += CUT_SHORT if kinds[row] >= 4 else 0
            elif letter == 68:                                                  # D
                self.cost += DELETE
            else:
                self._line("user" if state == U else "assistant", texts[row] if letter == 82 else "")
                self.cost += INSERT if letter == 73 else RECAST + (CUT_SHORT if kinds[row] >= 4 else 0)
            self.state = state

    def result(self) -> tuple:
        for role in LAST_INSERTS[self.state]:
            self.audit.append("I")
            self.cost += INSERT
            self._line(role, "")
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns
        return (self.key, gaps, *self.sums, self.cost, "".join(self.audit), self.hash.hexdigest())


def _result_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind)] + [(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
        ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose segments have about ``ROWS_AT_ONCE`` rows; ``column`` has a byte per row."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64) // ROWS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that are one segment."""
    for batch in _portions(batches, "codes"):
        rows = list(rows_of(iter([batch])))
        kinds = []
        for *_, codes, roles, texts in rows:
            seen: set[tuple] = set()
            repeated = []
            for row in zip(roles, texts):
                repeated.append(row in seen)
                seen.add(row)
            kinds.append(kinds_of(codes, repeated))
        nodes = Nodes(kinds, np.broadcast_to(ENDS, (len(rows), 4)))
        nodes.rank()
        out = []
        for (key, *parts), k, path in zip(rows, kinds, nodes.paths(np.zeros(len(rows), np.int64))):
            conversation = _Conversation(key)
            conversation.add(*parts, k, path)
            out.append(conversation.result())
        yield from collected(iter(out), _result_schema(batch.schema.types[0]))


# --- conversations of several segments ---------------------------------------------------------

def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds and cost table of each segment; ``firsts`` are the rows that repeat none before."""
    for batch in _portions(batches, "codes"):
        rows = list(rows_of(iter([batch])))
        kinds = []
        for _, _, codes, firsts in rows:
            new = set(firsts or ())
            kinds.append(kinds_of(codes, [i not in new for i in range(len(codes))]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(kinds, pa.binary()),
             pa.array(table_of(kinds).reshape(len(rows), 16).tolist(), pa.list_(pa.int64()))],
            names=["conv_id", "segment", "kinds", "costs"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost from each segment's end to a legal end of its conversation; segments come last first."""
    conversation, costs = None, ENDS
    for batch in batches:
        exits = []
        for key, table in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if (key,) != conversation:
                conversation, costs = (key,), ENDS
            exits.append(costs.tolist())
            costs = (np.array(table).reshape(4, 4) + costs).min(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(exits, pa.list_(pa.int64()))],
                                         names=["conv_id", "segment", "kinds", "exits"])


def _solved(batch: pa.RecordBatch) -> Nodes:
    nodes = Nodes(batch.column("kinds").to_pylist(), np.array(batch.column("exits").to_pylist()).reshape(-1, 4))
    nodes.rank()
    return nodes


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at each segment's end, for each state at its entry."""
    for batch in _portions(batches, "kinds"):
        nodes = _solved(batch)
        ends = np.stack([nodes.exit_states(np.full(batch.num_rows, s)) for s in range(4)], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends.tolist(), pa.list_(pa.int64()))],
                                         names=[*batch.schema.names, "ends"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at each segment's entry; segments come in order."""
    conversation, state = None, START
    for batch in batches:
        entries = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            if (key,) != conversation:
                conversation, state = (key,), START
            entries.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(entries, pa.int64())],
                                         names=["conv_id", "segment", "kinds", "exits", "entry"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches, "kinds"):
        paths = list(_solved(batch).paths(np.array(batch.column("entry").to_pylist())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([p[0] for p in paths], pa.binary()),
             pa.array([p[1] for p in paths], pa.list_(pa.int32())),
             pa.array([bytes(p[2]) for p in paths], pa.binary())],
            names=["conv_id", "segment", "kinds", "letters", "rows", "after"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from a stream in which the edits of each segment come before its rows."""
    kind: list[pa.DataType] = []

    def typed():
        for batch in batches:
            kind[:] = [batch.schema.types[0]]
            yield batch

    def results():
        conversation, edits = None, None
        for key, letters, rows, after, kinds, *parts in rows_of(typed(), 1):
            if letters is not None:
                edits = kinds, (letters, rows, list(after))
                continue
            if conversation is None or conversation.key != key:
                if conversation:
                    yield conversation.result()
                conversation = _Conversation(key)
            conversation.add(*parts, *edits)
        if conversation:
            yield conversation.result()

    rows = results()
    for first in rows:
        yield from collected((r for part in ((first,), rows) for r in part), _result_schema(kind[0]))


def _across(edge: DataFrame, kind: str) -> DataFrame:
    """Results of conversations whose segments may lie in several tasks."""
    n = int(edge.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # work is spread by count, not by bytes
    digests = F.transform("texts", lambda t: F.when(F.rlike(t, F.lit(f"[^{_WHITE}]")), F.sha2(t, 256)))
    rows = edge.select("conv_id", "segment", F.posexplode(F.arrays_zip("roles", digests.alias("digest")))) \
        .select("conv_id", "segment", "pos", "col.roles", "col.digest").filter("digest is not null")
    firsts = rows.groupBy("conv_id", "roles", "digest").agg(F.min(F.struct("segment", "pos")).alias("first")) \
        .groupBy("first.segment").agg(F.collect_list("first.pos").alias("firsts"))      # SEGMENT_ROWS at most
    narrow = f"conv_id {kind}, segment bigint, kinds binary"
    exits = edge.select("conv_id", "segment", "codes").join(firsts, "segment", "left") \
        .select("conv_id", "segment", "codes", "firsts").repartition(n, "segment") \
        .mapInArrow(_tables, f"{narrow}, costs array<bigint>") \
        .repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("segment")) \
        .mapInArrow(_exits, f"{narrow}, exits array<bigint>")
    entries = exits.repartition(n, "segment").mapInArrow(_moves, f"{narrow}, exits array<bigint>, ends array<bigint>") \
        .repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment") \
        .mapInArrow(_entries, f"{narrow}, exits array<bigint>, entry bigint")
    edits = entries.repartition(n, "segment").mapInArrow(
        _edits, f"{narrow}, letters binary, rows array<int>, after binary")
    return edits.unionByName(edge.drop("edge"), allowMissingColumns=True) \
        .repartition(n, "conv_id").sortWithinPartitions("conv_id", "segment", F.col("letters").isNull()) \
        .select("conv_id", "letters", "rows", "after", "kinds", "first_turn", "last_turn", "n_turns", "codes",
                "roles", "texts").mapInArrow(_joined, f"conv_id {kind}, {RESULT}")


def repair(damaged: DataFrame) -> DataFrame:
    """A row per conversation of ``damaged`` (``conv_id, turn, role, text``, the latter two not null).

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows of equal turn
    are ordered by role and by the SHA-256 of the text, rows without a turn come first; rows
    without ``conv_id`` are one conversation. Repeated rows are duplicates. The hash of a conversation is made in one
    task, as a stream of its segments; other columns are not read; an empty table gives no row.
    """
    kind = damaged.schema["conv_id"].dataType.simpleString()
    segments = written(segments_of(damaged), "segments")
    whole = segments.filter("not edge").select(
        "conv_id", "first_turn", "last_turn", "n_turns", "codes", "roles", "texts") \
        .mapInArrow(_whole, f"conv_id {kind}, {RESULT}")
    return whole.unionByName(_across(segments.filter("edge"), kind))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row of zeros for a conversation that lost all its rows."""
    gone = F.when(F.pmod(F.crc32(F.concat(*[x for c, end in (("conv_id", ":"), ("turn", "")) for x in (
        F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(end))]).cast("binary")), F.lit(20)) == 0, 0).otherwise(1)
    lost = conversations.groupBy("conv_id").agg(F.max(gone).alias("left")).filter("left = 0").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.lit("").alias("audit"), F.lit(_EMPTY_HASH).alias("repaired_sha256"))
    return repair(damage(conversations)).unionByName(lost)
