"""The pipeline as a whole and its stages against plain versions on the smallest data."""

import corpus_pipeline as pipeline
from tests.llm.conftest import CLASHING
from tests.llm.test_text_operators import plain_components, plain_contamination
from tracewell.llm import quality, queries


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        before, after = docs, pipeline.written(stage(spark, docs, data), "stage")
        assert after.columns == columns, name
        rows, kept = before.collect(), {r.doc_id for r in after.collect()}
        if name == "quality classifier":
            scores = quality.classify(before, spark.read.parquet(f"{data}/labels.parquet")).collect()
            assert kept == {r.doc_id for r in scores if r.predicted}
        elif name == "near-duplicates":
            assert kept == set(plain_components([(r.doc_id, r.text) for r in rows]).values())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            for r in rows:
                words, hit, *_ = plain_contamination(r.text, items)
                assert (r.doc_id in kept) == (not (hit and 20 * hit >= words)), r.doc_id
        else:
            words = {r.doc_id: len(r.text.split()) for r in rows}
            assert sum(words[i] for i in kept) >= 0.9 * sum(words.values()) - 1
        docs = after
    sharded = pipeline.sharding_stage(spark, docs, data).collect()
    sizes = {}
    for r in sharded:
        sizes[r.shard_id] = sizes.get(r.shard_id, 0) + len((r.text or "").encode())
    assert {r.doc_id for r in sharded} == kept and max(sizes.values()) <= queries.SHARD_BYTES


def test_run(spark, data):
    found = pipeline.run(spark, data)
    assert found.columns[-1] == "shard_id" and found.count() > 0


def test_stages_take_empty_tables(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_stages_keep_columns_of_any_name(spark, data, clashing):
    plain = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in pipeline.STAGES:
        got = stage(spark, clashing, data)
        assert got.columns[:len(plain.columns)] == plain.columns
        assert sorted(got.columns) == sorted(clashing.columns), name
        rows = got.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, plain, data).collect()}, name
        assert {r["a.b"] for r in rows} == {"d"} and {r["_text"] for r in rows} == {CLASHING.index("_text")}
