import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import decontamination, near_dedup, quality, repeats, toxicity
from tracewell.llm.common import told_apart
from tracewell.llm.components import components
from tracewell.llm.fitting import isotonic

SCHEMA = "doc_id long, text string"


def rows_by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# --- near-duplicates ---------------------------------------------------------------------------

def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def plain_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    docs, base = [], []
    for k in range(60):
        base.append([f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))])
    for k in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        docs.append((k, " ".join(words)))
    got = rows_by_id(near_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)))
    want = plain_components(docs)
    assert {i: got[i].component_id for i in got} == want
    assert all(got[i].n_shingles == len(shingles(t)) for i, t in docs)
    assert {i for i in got if got[i].kept} == set(want.values())


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(250):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    got = rows_by_id(near_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)))
    assert {i: got[i].component_id for i in got} == plain_components(docs)


def test_large_component_and_outsiders_in_one_band(spark, monkeypatch):
    # Groups of a common core, linked inside but mostly not with each other, share bands.
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(12)
    core, docs = [f"c{k}" for k in range(120)], []
    for group, size in enumerate([90, 9, 7, 5, 3, 2] + [1] * 25):
        own = core[:80 + rng.randrange(6)] + [f"g{group}x{k}" for k in range(22 + rng.randrange(8))]
        for _ in range(size):
            words = list(own)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    rng.shuffle(docs)
    got = rows_by_id(near_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)))
    want = plain_components(docs)
    assert len(set(want.values())) > 3 and {i: got[i].component_id for i in got} == want


def test_rows_of_one_id_and_text(spark):
    words = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(words))] * 400 + [(2, " ".join(words[:-3] + ["x", "y"]))] * 300 + [(3, "some other words")] * 50
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == {(1, 1, True): 400, (2, 1, False): 300, (3, 3, True): 50}


def test_chance_twins_are_told_apart(spark):
    rows = spark.createDataFrame([(7, 1, "a"), (7, 1, "b"), (7, 2, "c"), (8, 5, "d")], "k long, c long, t string")
    got = {r.t: r.k for r in told_apart(rows, "k", "c").collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] == 8 and len(set(got.values())) == 3


def test_near_duplicates_of_awkward_rows(awkward, no_documents):
    found = near_dedup.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[2]] == [1, 1] and by[1][0].kept
    assert sorted((r.n_shingles, r.component_id) for r in by[None]) == sorted([(10, 1), (0, None)], key=str) \
        or {(r.n_shingles, r.component_id) for r in by[None]} == {(10, 1), (0, None)}
    assert all(by[k][0].n_shingles == 0 and by[k][0].component_id == k for k in (3, 4, 5))
    assert by[11][0].component_id == 10 and by[7][0].component_id == 1
    assert near_dedup.near_duplicates(no_documents).collect() == []


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for shared in (300, 600, 900):
        a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
        b = np.concatenate((a[:shared], rng.integers(0, 1 << 62, 1000 - shared).astype(np.uint64)))
        _, sketch = near_dedup.signatures(np.concatenate((np.sort(a), np.sort(b))), np.array([1000, 1000]))
        bits = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        estimate = 1 + near_dedup.BITS / 2 * np.log(1 - 2 * bits / near_dedup.BITS) / (2 * near_dedup.SAMPLES)
        assert abs(estimate - shared / (2000 - shared)) < 0.15


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


# --- decontamination ---------------------------------------------------------------------------

def plain_contamination(text, items):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    w, hit, named = words(text), set(), set()
    for name, t in items:
        v = words(t)
        size = min(len(v), 13)
        windows = {tuple(v[k:k + size]) for k in range(len(v) - size + 1)} if v else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k:k + size]) in windows:
                hit |= set(range(k, k + size))
                named.add(str(name))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()


@pytest.mark.parametrize("block", [32 << 20, 400])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(1)
    items = [(k, " ".join(f"t{rng.randrange(30)}" for _ in range(rng.choice([2, 5, 13, 20, 40])))) for k in range(12)]
    items += [(3, "extra words of item three"), (None, "no id here"), (50, None), (51, "!!")]
    docs = []
    for k in range(80):
        parts = [rng.choice(items)[1] or "" for _ in range(rng.randrange(3))]
        cut = [p[rng.randrange(len(p) // 2 + 1):] for p in parts]
        docs.append((k, " - ".join(cut + [" ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(60)))])))
    docs += [(90, None), (91, "")]
    found = decontamination.find_matches(spark.createDataFrame(docs, SCHEMA),
                                         spark.createDataFrame(items, "item_id long, text string"))
    named = [("" if i is None else i, t) for i, t in items]
    got = decontamination.judge(found).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == plain_contamination(r.text, named), r.doc_id
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        for m in r.matches:
            assert m.n_words > 0 and m.doc_word + m.n_words <= r.n_words


def test_decontamination_of_awkward_rows(spark, awkward, no_documents):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")],
                                  "item_id long, text string")
    kept = decontamination.clean(awkward, items).collect()
    assert {r.doc_id for r in kept} == {3, 4, 5, 6, 8, 9, 10, 11, 12, None}
    assert decontamination.clean(no_documents, items).collect() == []
    empty = decontamination.judge(decontamination.find_matches(awkward, items.limit(0), keep=["doc_id"]))
    assert all(r.n_hit == 0 for r in empty.collect())


# --- repeats -----------------------------------------------------------------------------------

def plain_repeats(docs, length):
    count = Counter(b[p:p + length] for _, b in docs for p in range(len(b) - length + 1))
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("merge", [repeats.MERGE, 4])
def test_repeats_equal_brute_force(spark, monkeypatch, merge):
    monkeypatch.setattr(repeats, "MERGE", merge)
    rng = random.Random(9)
    letters = "ab éx"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(150, 420))) for _ in range(6)]
    docs = []
    for k in range(60):
        text = "".join(rng.choice([rng.choice(parts), "".join(rng.choice(letters) for _ in range(rng.randrange(250)))])
                       for _ in range(rng.randrange(5)))
        docs.append((k, text))
    docs += [(70, "z" * 900), (71, "z" * 150), (72, None), (73, docs[5][1]), (73, docs[5][1]), (74, "ab" * 450)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    want = plain_repeats([(i, (t or "").encode()) for i, t in docs], repeats.LENGTH)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    docs = [(1, "".join(rng.choice("abcdefgh ") for _ in range(3000)) + part), (2, part + "end"), (3, part[300:501])]
    got = repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    want = plain_repeats([(i, t.encode()) for i, t in docs], repeats.LENGTH)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeated_rows_cost_no_more_than_rows_of_their_own(spark):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh ") for _ in range(400))
    few = [(5, "head " + part), (6, part[100:350] + " tail of its own"), (None, part), (9, "w" * 199)]
    docs = [few[0]] * 3000 + [few[1]] + [few[2]] * 2000 + [few[3]] * 20
    start = time.time()
    got = repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(6)).collect()
    spent = time.time() - start
    want = {r[0]: r[1:] for r in plain_repeats([(i, t.encode()) for i, t in [few[0]] * 2 + [few[1]] + [few[2]] * 2 + [few[3]]],
                                               repeats.LENGTH)}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert spent < 60                   # pairs of 3,000 rows took over twenty minutes


def test_repeats_of_awkward_rows(awkward, no_documents):
    found = repeats.remove_repeats(awkward).collect()
    assert len(found) == awkward.count()
    assert repeats.remove_repeats(no_documents).collect() == []


def test_interleave_orders_suffixes():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, (200, 24)).astype(np.uint8)
    text[50:60] = text[40:50]
    block = rng.integers(0, 3, 200)
    order, common = repeats.interleave(block, text)
    keys = [(block[k], bytes(text[k])) for k in order]
    assert keys == sorted(keys)
    for r in range(1, 200):
        (a, x), (b, y) = keys[r - 1], keys[r]
        same = next((k for k in range(24) if x[k] != y[k]), 24) if a == b else 0
        assert common[r] == same


# --- classifiers -------------------------------------------------------------------------------

def test_isotonic_pools_violators():
    x, level = isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert list(level) == sorted(level) and level[0] == 0 and level[-1] == 1


def test_classifiers_on_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 12)] + [(None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    for run in (quality.classify, toxicity.score_documents):
        rows = run(awkward, labels).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
        assert run(no_documents, labels).collect() == []
        assert {r.score for r in run(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_accepted(awkward, labels).columns == awkward.columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automata_find_words_within_one_edit():
    rng = random.Random(5)
    words = ["idiot", "trash", "scum", "pathetic", "clown"]
    trie = toxicity.Trie([(w + "$", 5.0) for w in words] + [("lowei", 4.0)])
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = rng.choice(["", "a", "s", "t"])
        w = "".join(w)
        want = w in words or any(len(t) >= 5 and distance(w, t) <= 1 for t in words)
        assert bool(trie.match(w)[0]) == want, w
    assert trie.match("loweischaft") == ("lowei", 4.0)
    assert toxicity.Trie([("clown$", 5.0)], ["crown"]).match("crown") == ("", 0.0)


def test_quoted_terms_weigh_less():
    trie = toxicity.Trie([("idiot$", 5.0)])
    open_, hits = toxicity.evidence("you are an idiot, an idiott", trie)
    quoted, marks = toxicity.evidence('he said "you idiot" and „idiot“ again', trie)
    assert [h[2] for h in hits] == [False, False] and [h[2] for h in marks] == [True, True]
    assert quoted[0] < open_[0] and quoted[2] == 0


def test_one_block_of_test_items_at_a_time(spark, monkeypatch):
    """Repeated items fill no block, and a block is gone before the next one is sent."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)] + [("i0", texts[0])] * 500,
                                  "item_id string, text string")
    docs = spark.createDataFrame([(k, f"so {t} end") for k, t in enumerate(texts)], SCHEMA)
    sent, held, most = [], [], []
    send = spark.sparkContext.broadcast

    def counting(value):
        shared = send(value)
        sent.append(len(value))
        held.append(shared)
        most.append(len(held))
        destroy = shared.destroy
        monkeypatch.setattr(shared, "destroy", lambda *a: (held.remove(shared), destroy(*a)))
        return shared

    whole = decontamination.find_matches(docs, items, keep=["doc_id"]).collect()
    monkeypatch.setattr(spark.sparkContext, "broadcast", counting)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2_000)
    parts = decontamination.find_matches(docs, items, keep=["doc_id"]).collect()
    assert sum(sent) == 40 and len(sent) > 2 and max(most) == 1
    assert sorted(parts) == sorted(whole) and all(len(r.matches) == 1 for r in parts)
