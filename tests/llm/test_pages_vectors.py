import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import extraction, topk, warc

PAGES = "page_id long, url string, html string, text string, digest int"


@pytest.fixture(scope="module")
def trained():
    return extraction.train([(extraction._featured(b), y) for b, y in extraction.made_pages(250)])


def test_field_on_held_out_layouts(trained):
    right = total = 0
    for blocks, labels in extraction.made_pages(150, seed=77):
        got = trained.labels(extraction._featured(blocks))
        right, total = right + int((got == labels).sum()), total + len(labels)
    assert right >= 0.98 * total


def test_viterbi_equals_brute_force(trained):
    rng = random.Random(0)
    names = list(trained.number)
    page = [rng.sample(names, 6) for _ in range(8)]
    score = [trained.weights[[trained.number[f] for f in b]].sum(axis=0) for b in page]

    def total(path):
        return sum(s[x] for s, x in zip(score, path)) + sum(trained.moves[a, b] for a, b in zip(path, path[1:]))

    best = max((tuple(int(c) for c in f"{k:08b}") for k in range(256)), key=total)
    assert tuple(trained.labels(page)) == best


def test_extraction(spark, trained):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>"
            "<div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  par,\n with <i>markup</i>.<br>"
            "<p>Second&nbsp;one: 1 &lt; 2.<script>var t='</p>';</script></p><form><p>Your mail</p></form>"
            "<section class=comments><h3>Comments</h3><p>I disagree with all of this.</p></section></article>"
            "<footer>&copy; site</footer>")
    rows = [(1, "u", html), (2, None, None), (3, "v", ""), (None, "w", html), (1, "u", html),
            (5, "x", "<article><p>" + "long " * 100_000), (6, "y", "<<<>>> &#xD800; </p></article>")]
    frame = spark.createDataFrame([(*r, "t", 0) for r in rows], PAGES)
    got = {(r.page_id, r.url): r for r in extraction.extract(frame, trained).collect()}
    want = "A & B\nFirst par, with markup.\nSecond one: 1 < 2."
    assert got[1, "u"].text == want and got[1, "u"].n_chars == len(want) and got[None, "w"].text == want
    assert got[2, None].text == "" and got[3, "v"].n_chars == 0
    assert got[5, "x"].text == ("long " * 100_000).strip()
    assert extraction.extract(frame.limit(0), trained).collect() == []


def test_archives_round_trip(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdef é\r\n") for _ in range(200_000))
    rows = [(1, "http://a/\r\nX: y", "x" * 150), (2, "http://b", "x" * 150), (2, "http://b", "x" * 150),
            (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "n", "y" * 120),
            (None, "n2", "y" * 120), (9000, "ü", long), (9001, "u", "\r\n\r\n" + "z" * 100)]
    rows += [(100 + k, f"p{k}", f"<p>{k}</p>" * 30) for k in range(200)]
    frame = spark.createDataFrame([(*r, "t", 0) for r in rows], PAGES)
    path = warc.write_archives(frame, roll_bytes=4000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        head = first.get(h)
        revisit = head is not None and head != i
        want.append((i, u, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                     head if revisit else None, None if revisit else h or ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    files = spark.read.parquet(f"{path}/manifest").collect()
    assert len(files) > 5 and sum(f.n_records for f in files) == len(rows)
    again = spark.read.parquet(f"{warc.write_archives(frame.repartition(7), roll_bytes=4000)}/manifest").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, files))           # same files whatever the layout
    assert warc.read_archives(spark, warc.write_archives(frame.limit(0))).collect() == []


def test_archives_are_read_in_many_partitions(spark):
    pages = spark.range(40).selectExpr("id * 4096 as page_id", "'u' as url", "repeat(cast(id as string), 200) as html")
    path = warc.write_archives(pages)
    assert spark.read.parquet(f"{path}/manifest").count() == 40
    read = warc.read_archives(spark, path)
    parts = read.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 3 and sum(r["count"] for r in parts) == 40


def test_levels_of_an_index_are_bounded():
    rng = np.random.default_rng(3)
    for scale in (0.001, 1, 1000):
        vectors = topk.integers((rng.normal(size=(500, 16)) * scale).tolist(), 16)
        index = topk.Index(np.arange(500), vectors)
        assert len(index.segments) <= topk.LEVELS + 1
        floor = np.sort(vectors[:5] @ vectors.T, axis=1)[:, -4].astype(float)     # some better rows are elsewhere
        found = list(index.top(np.arange(1000, 1005), vectors[:5], 3, floor))
        best = {q: sorted((-s, r) for own, r, s in found if own == 1000 + q) for q in range(5)}
        for q in range(5):
            want = sorted((-int(s), r) for r, s in enumerate(vectors @ vectors[q]))[:3]
            assert best[q] == want


def plain_top(rows, queries, k):
    def ints(v, width=8):
        return np.floor(256 * np.pad(np.array(v, float), (0, width - len(v)))).astype(np.int64)

    usable = [(i, ints(v)) for i, v in rows if v is not None and i is not None
              and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in queries:
        own = next((v for i, v in usable if i == q), None)
        if own is not None:
            best = sorted((-int(own @ v), i) for i, v in usable if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, shard", [(16_384, 8_192), (3, 40)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).round(1).tolist()) for k in range(400)]
    rows += [(400 + k, rows[k % 5][1]) for k in range(60)]                      # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")]), (504, []),
             (505, [3.0]), (None, [9.0] * 8), (506, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    asked = [k for k in range(0, 510, 10) if k < 460 or k in (500, 504, 505, 506)]
    got = topk.top_k(frame, frame.filter("vec_id % 10 = 0 or vec_id >= 500"), 5)
    want = plain_top(rows, sorted({*asked, *range(500, 507)}), 5)
    assert sorted(map(tuple, got.collect())) == want
    few = frame.limit(3)
    assert len(topk.top_k(few, few).collect()) == 6
    assert topk.top_k(frame.limit(0), frame.limit(0)).collect() == []
