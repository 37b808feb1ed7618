"""Filter audits against plain counts, and merges against sets."""

import re
from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import audit

ids = st.lists(st.integers(0, 60)).map(lambda x: sorted(set(x)))


@settings(max_examples=200, deadline=None)
@given(st.lists(ids, max_size=5), ids, ids)
def test_merges(lists, a, b):
    assert audit.union(lists) == sorted(set().union(*lists))
    assert audit.n_new(a, b) == len(set(a) - set(b))
    assert audit._common(a, b) == sorted(set(a) & set(b))


def plain(docs, labels):
    """Applies the filters one after the other, for each order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs]
    fails = []
    for r, w in zip(docs, words):
        text = r.text or ""
        fails.append({
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": r.doc_id is not None and any(
                o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in docs)})
    out = {}
    for part in {r.source or "" for r in docs}:
        mine = [i for i, r in enumerate(docs) if (r.source or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i in left if fails[i][f]]
                left = [i for i in left if not fails[i][f]]
                shapley[f] += len(gone)
                lost = [sum(docs[i].doc_id is not None and (docs[i].doc_id, 1) in labels[k] for i in gone) for k in (0, 1)]
                out[part, order, step] = [
                    len(left), len(gone), sum(fails[i][f] for i in mine) - len(gone),
                    sum(fails[i][f] and sum(fails[i].values()) == 1 for i in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(docs, labels):
    found = audit.audit_filters(docs, labels).collect()
    marks = [{(r.doc_id, r.quality) for r in labels.collect()}, {(r.doc_id, r.toxic) for r in labels.collect()}]
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found}
    assert len(got) == len(found) and got == plain(docs.collect(), marks)


def test_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (None, 1, 1), (8, 1, None)],
                                   "doc_id long, quality int, toxic int")
    check(awkward, labels)
    check(awkward.unionByName(awkward), labels.limit(0))
    assert audit.audit_filters(no_documents, labels).collect() == []


def test_blocks_of_a_part_add_up(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = audit.failing_rows(docs, spark.read.parquet(f"{data}/labels.parquet"))
    lists = audit.posting_lists(rows, 5, block=3).collect()
    assert max(r.n_rows for r in lists) == 3 and sum(r.n_rows for r in lists) == docs.count()
    small = audit.audit(audit.posting_lists(rows, 5, block=3), "ABCDE").collect()
    assert sorted(small) == sorted(audit.audit(audit.posting_lists(rows, 5), "ABCDE").collect())
