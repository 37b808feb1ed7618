"""Whole results of operators without SQL against plain versions on one thread."""

import zlib

import numpy as np

from tracewell.llm import extraction, quality
from tracewell.llm.queries import QUERIES


def plain_isotonic(x, y):
    """Least rising means of ``y`` in order of ``x``: the largest of the least means that end at a place."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    places, at = np.unique(x, return_inverse=True)
    n, s = np.bincount(at), np.bincount(at, y)
    n, s = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(s)))
    level = [max(min((s[j] - s[i]) / (n[j] - n[i]) for j in range(k + 1, len(n))) for i in range(k + 1))
             for k in range(len(places))]
    return places, np.array(level)


def test_quality_scores(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    x = np.array([quality.statistics(r.text) for r in docs])
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 for r in docs])
    known = np.array([r.doc_id in labels and fold[i] != 0 for i, r in enumerate(docs)])
    y = np.array([labels.get(r.doc_id, 0) for r in docs], float)
    mean, scale = x[known].mean(axis=0), x[known].std(axis=0)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -6, 6)
    inputs = np.concatenate((np.ones((len(z), 1)), quality.fourier(z)), axis=1)

    def ridge(rows):
        a = inputs[rows]
        penalty = 1e-3 * rows.sum() * np.eye(a.shape[1])
        penalty[0, 0] = 0
        return np.linalg.solve(a.T @ a + penalty, a.T @ y[rows])

    raw = np.zeros(len(docs))
    for f in range(1, 5):
        mine = known & (fold == f)
        raw[mine] = inputs[mine] @ ridge(known & (fold != f))
    places, level = plain_isotonic(np.round(np.clip(raw[known], -1, 2) * 512) / 512, y[known])
    blocks = [np.flatnonzero(np.isclose(level, v, atol=1e-12)) for v in np.unique(np.round(level, 12))]
    count = np.array([(np.round(np.clip(raw[known], -1, 2) * 512) / 512 == p).sum() for p in places])
    knots = [np.average(places[b], weights=count[b]) for b in blocks]
    want = np.interp(inputs @ ridge(known), knots, [level[b[0]] for b in blocks])
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, data).collect()}
    for r, score, f in zip(docs, want, fold):
        assert abs(got[r.doc_id].score - score) < 1e-4, r.doc_id
        assert got[r.doc_id].held_out == (f == 0) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_extracted_texts_are_those_of_the_best_labels(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    field = extraction.fit_field(pages)
    got = {r.page_id: r.text for r in extraction.extract(pages, field).collect()}
    checked = 0
    for r in pages.collect():
        blocks = extraction.leaf_blocks(r.html)
        if not blocks or len(blocks) > 14:
            continue
        scores = [field.weights[[field.number[f] for f in b if f in field.number]].sum(axis=0)
                  for b in extraction._featured(blocks)]
        best, chosen = -np.inf, None
        for k in range(1 << len(blocks)):               # every labelling of the page
            path = [k >> i & 1 for i in range(len(blocks))]
            total = sum(s[p] for s, p in zip(scores, path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))
            if total > best:
                best, chosen = total, path
        assert got[r.page_id] == "\n".join(b.text for b, p in zip(blocks, chosen) if p == extraction.MAIN)
        checked += 1
    assert checked > 5
