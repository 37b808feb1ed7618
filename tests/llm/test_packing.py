"""Packings against the ids of the tokenizer: every id once, sequences without gaps, little padding."""

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import packing
from tracewell.llm.queries import QUERIES

FILE, RANKS = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
PLAIN = Tokenizer.from_file(FILE)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module", params=["ranks", "file alone"])
def tokens(request):
    return packing.Tokens(FILE, RANKS, public_tokenizers.PATTERN) if request.param == "ranks" else packing.Tokens(FILE)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 1.'s\n\t ᠎\x1c<|endoftext|>é漢"), st.characters(codec="utf-8"))))
def test_ids(tokens, text):
    for t in (text, text + "<|endoftext|>" + text, text + " " * 600 + text, text + "x" * 600):
        ids = plain_ids(t)[:-1]
        assert tokens.blob(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_ids_of_long_texts(tokens, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    for t in ("x" * 3000 + " some words, and\n more  of  them" * 50, "word " * 400 + "  a" * 300, "y" * 20_000):
        ids = plain_ids(t)[:-1]
        assert tokens.blob(t) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 200_000))
def test_lengths(n):
    found = packing.lengths(n)
    assert sum(found) == n and all(1 <= x <= packing.CAPACITY for x in found)
    assert len([x for x in found if x < packing.CAPACITY]) <= 6


def check(docs, pieces, capacity=2048):
    """``docs``: (id, text) rows. Returns the padding of all sequences."""
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.doc_id, p.row].append(p)
    assert Counter(k for k, _ in by_row) == Counter(k for k, _ in docs)
    texts = defaultdict(list)
    for key, text in docs:
        texts[key].append(plain_ids(text))
    for (key, _), found in by_row.items():
        found.sort(key=lambda p: p.start)
        assert [p.start for p in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
        match = [ids for ids in texts[key] if len(ids) == found[0].doc_tokens and all(
            zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start:p.start + p.length])) == p.ids_crc32 for p in found)]
        assert match and sum(p.length for p in found) == len(match[0]) and {p.doc_tokens for p in found} == {len(match[0])}
        texts[key].remove(match[0])
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append(p)
    padding = 0
    for found in bins.values():
        found.sort(key=lambda p: p.offset)
        assert [p.offset for p in found] == [sum(q.length for q in found[:i]) for i in range(len(found))]
        n = sum(p.length for p in found)
        assert 0 < n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    return padding


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    pieces = QUERIES["op12_packing"](spark, data).collect()
    assert check(docs, pieces) <= 0.003 * sum(p.length for p in pieces)


def test_tasks_pool_what_they_cannot_fill(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(16)
    frame = packing.pack(docs, FILE, capacity=256)
    pieces = frame.collect()
    assert check([(str(i), t) for i, t in rows], pieces, 256) <= 0.003 * sum(p.length for p in pieces)
    kinds = Counter(p.sequence_id // packing.POOLED for p in pieces)
    assert kinds[0] and kinds[1] and kinds[2]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 60)) for i in range(120)], "doc_id long, text string")
    frame = packing.pack(docs, FILE, with_ids=True, ranks=RANKS, pattern=public_tokenizers.PATTERN)
    found = packing.sequences(frame).collect()
    assert Counter(t for r in found for t in struct.unpack(f"<{r.n_tokens}I", r.tokens)) == Counter(
        t for r in docs.collect() for t in plain_ids(r.text))
    assert all(r.n_tokens + r.padding == 2048 or (r.padding == 0 and r.n_tokens.bit_count() == 1) for r in found)


def test_awkward_rows(spark, awkward, no_documents):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(rows, packing.pack(awkward, FILE, ranks=RANKS, pattern=public_tokenizers.PATTERN).collect())
    assert packing.pack(no_documents, FILE).collect() == []
