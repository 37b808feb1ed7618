"""Every query of the package against its SQL, and the shape of those without SQL."""

import math

import pytest

from tracewell.llm.queries import ORACLES, QUERIES


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_numbers_of_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.9), ("op7_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, folder).collect()]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)
