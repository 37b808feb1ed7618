"""Conversation repair against a plain search over whole audits."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import repair

WHITE = " \t\n\x0b\x0c\r"
ROLES = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def plain_repair(rows):
    """One conversation: keeps the least (cost, audit) and its lines for each state, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    then = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def inserts(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                new = (cost + 5, audit + "I", lines + [full[then[state]] + ":"])
                states[then[state]] = min(states.get(then[state], new), new)
        return states

    states, seen, last = {"": (0, "", [])}, set(), None
    for _, _, role, text in rows:
        must = short = False
        if not text.strip(WHITE):
            must, _ = True, sums.update(blank=sums["blank"] + 1)
        elif (role, text) in seen:
            must, _ = True, sums.update(duplicate=sums["duplicate"] + 1)
        elif text.rstrip(WHITE)[-1] not in ".!?":
            short, _ = True, sums.update(truncated=sums["truncated"] + 1)
        seen.add((role, text))
        if last is not None and last + role[:1] not in ("su", "ua", "au"):
            sums["illegal"] += 1
        last = role[:1]
        after = {}

        def reach(state, *new):
            after[state] = min(after.get(state, new), new)

        for state, (cost, audit, lines) in inserts(states).items():
            reach(state, cost + 2, audit + "D", lines)
            if not must:
                initial = role[:1]
                if initial == then[state] or (state == "" and initial == "s"):
                    reach(initial, cost + 5 * short, audit + "K", lines + [f"{role}:{text}"])
                reach(then[state], cost + 1 + 5 * short, audit + "R", lines + [f"{full[then[state]]}:{text}"])
        states = after
    cost, audit, lines = min(v for k, v in inserts(states).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *sums.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return {k: plain_repair(v) for k, v in by.items()}


def results(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


rows_ = st.lists(st.tuples(st.just(1), st.integers(0, 6) | st.none(),
                           st.sampled_from(["system", "user", "assistant", "tool", "", "agent"]),
                           st.sampled_from(["A.", "B?", "cut", "", " \t", "C! "])), min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(rows_, min_size=1, max_size=4), st.integers(1, 3))
def test_least_audits_within_and_across_segments(conversations, size):
    whole = []
    for rows in conversations:
        rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, repeated, codes = set(), [], []
        for _, _, role, text in rows:
            repeated.append((role, text) in seen)
            seen.add((role, text))
            codes.append(repair.CLASSES.get(role[:1], 0) + (0 if text.strip() else 4)
                         + (0 if text.strip()[-1:] in tuple(".!?") else 8))
        whole.append(repair.kinds_of(bytes(codes), repeated))
    nodes = repair.Nodes(whole, repair.ENDS[None].repeat(len(whole), 0))
    nodes.rank()
    import numpy as np
    for rows, kinds, path in zip(conversations, whole, nodes.paths(np.zeros(len(whole), int))):
        expected = plain_repair(rows)
        assert path[0].decode() + {0: "", 1: "II", 2: "I", 3: ""}[path[2][-1] if path[2] else 0] == expected[6]
        parts = [kinds[i:i + size] for i in range(0, len(kinds), size)]
        exits, costs = [], repair.ENDS
        for table in repair.table_of(parts)[::-1]:
            exits.append(costs)
            costs = (table + costs).min(axis=1)
        assert costs[0] == expected[5]
        pieces = repair.Nodes(parts, np.array(exits[::-1]))
        pieces.rank()
        moves, state, entries = np.stack([pieces.exit_states(np.full(len(parts), s)) for s in range(4)], 1), 0, []
        for move in moves:
            entries.append(state)
            state = move[state]
        joined = b"".join(p[0] for p in pieces.paths(np.array(entries))).decode()
        assert joined + {0: "", 1: "II", 2: "I", 3: ""}[int(state)] == expected[6]


@pytest.fixture(scope="module")
def awkward_rows():
    rows = [(1, t, r, x) for t, (r, x) in enumerate(
        [("user", "Hi."), ("assistant", "Yes?"), ("user", "cut"), ("assistant", "Ok!"), ("user", "Hi."), ("x", None)])]
    rows += [(2, None, "user", "A."), (2, None, "user", "A."), (2, 5, None, "B."), (2, 9, "assistant", "B.")]
    rows += [(None, 1, "user", "q."), (None, None, "assistant", None), (4, None, None, None)]
    rows += [(5, t, ["user", "assistant"][t % 2], f"turn {t * 7 % 50} of it." * (t % 3)) for t in range(300)]
    rows += [(c, t, ["system", "user", "assistant"][(c * t) % 3], "T%d." % (t % 4)) for c in range(6, 90) for t in range(c % 7)]
    return rows + [(91, 1, "assistant", "long " * 50_000)]


@pytest.mark.parametrize("limit", [7, 4096])
def test_awkward_rows(spark, awkward_rows, limit, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", limit)
    monkeypatch.setattr(repair, "ROWS_AT_ONCE", 20)
    frame = spark.createDataFrame(awkward_rows, ROLES).withColumn("segment", repair.F.lit(1)).repartition(5)
    expected = plain(plain_damage(awkward_rows))
    lost = {r[0] for r in awkward_rows} - set(expected)
    expected |= {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in lost}
    assert lost and results(repair.repair_damaged(frame)) == expected


def test_conversation_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 64)
    rows = [(1, t // 2, ["user", "assistant", "system"][t * t % 3], f"say {t % 400}" + ".,"[t % 5 == 0])
            for t in range(3000)] + [(1, 7, "user", "same row.")] * 200 + [(2, 1, "user", "x."), (2, 2, "assistant", "y.")]
    frame = spark.createDataFrame(rows, ROLES).repartition(6)
    assert results(repair.repair(frame)) == plain(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    segments = repair.segments_of(frame).select("conv_id", "segment", repair.F.size("roles")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r[2] for r in segments) <= 64 and len({r[1] >> repair.TASK_SHIFT for r in segments}) > 4


def test_empty_table(spark):
    assert repair.repair_damaged(spark.createDataFrame([], ROLES)).collect() == []
