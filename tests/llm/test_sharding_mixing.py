from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing, sharding


def test_shards_fit_and_split_only_where_needed(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"))
    found = sharding.assign_shards(rows, 200).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard_id] += 10
    assert len(found) == 3000 and max(sizes.values()) <= 200
    for name in sizes:                                      # a parent would not have fitted
        depth, prefix = map(int, name.split("-"))
        if depth:
            parent = sum(n for s, n in sizes.items() for d, p in [map(int, s.split("-"))]
                         if d >= depth - 1 and p >> (d - depth + 1) == prefix >> 1)
            assert parent > 200


def test_hot_key_equal_rows_and_oversized_rows(spark):
    rows = [(1, f"text {k:04d}") for k in range(400)] + [(2, "same text")] * 100 + [(3, "y" * 500)] * 3
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r.shard_id] += len(r.text)
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    assert all(n <= 90 or s.startswith("solo-") for s, n in sizes.items())
    assert sorted(n for s, n in sizes.items() if s.startswith("solo-")) == [500] * 3


def test_shards_of_awkward_rows(awkward, no_documents):
    found = sharding.assign_shards(awkward, 1000)
    assert found.columns == [*awkward.columns, "shard_id"]
    assert Counter(map(tuple, found.drop("shard_id").collect())) == Counter(map(tuple, awkward.collect()))
    assert sharding.assign_shards(no_documents, 1000).collect() == []


def test_written_shards(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"))
    path = sharding.write_shards(sharding.assign_shards(rows, 100))
    assert spark.read.parquet(f"{path}/data").count() == 50
    assert spark.read.parquet(f"{path}/manifest").agg(F.sum("n_rows")).first()[0] == 50


def weights(domain, lang, source):
    return {c: mixing.weight_of(w, c, 1) for c, w in (("domain", domain), ("lang", lang), ("source", source))}


def taken(frame):
    out = Counter()
    for r in frame.collect():
        out[r.domain, r.lang, r.source] += r.taken
    return out


def corpus(spark, sizes):
    rows = [(k, f"{s}{i}", " ".join(["w"] * n), lang, s) for k, (s, lang, n, m) in enumerate(sizes) for i in range(m)]
    return spark.createDataFrame([(i, t, lang, s) for i, (_, _, t, lang, s) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string")


def test_shortage_goes_to_siblings_first(spark):
    # a/en holds 10 words only; its sibling language gets the rest before the other domain does.
    docs = corpus(spark, [("a1", "en", 10, 1), ("a2", "de", 10, 30), ("b1", "en", 10, 60)])
    found = taken(mixing.mix(docs, F.substring("source", 1, 1), weights({}, {}, {}), (4, 10)))
    total = 910 * 4 // 10
    assert sum(found.values()) == total
    assert found["a", "en", "a1"] == 10 and found["a", "de", "a2"] == total // 2 - 10
    assert found["b", "en", "b1"] == total - total // 2


def test_short_subtree_passes_the_rest_up_and_epochs_repeat(spark):
    docs = corpus(spark, [("a1", "en", 5, 2), ("b1", "en", 7, 40)])
    found = mixing.mix(docs, F.substring("source", 1, 1), weights({"a": 9}, {}, {}), (1, 2), 3)
    got = taken(found)
    assert got["a", "en", "a1"] == 30 and got["b", "en", "b1"] == 290 // 2 - 30
    epochs = Counter(r.epoch for r in found.collect() if r.domain == "a")
    assert epochs == {0: 2, 1: 2, 2: 2}
    cut = [r for r in found.collect() if r.taken < r.n_tokens]
    assert len(cut) <= 1


def test_mixing_awkward_rows(awkward, no_documents):
    found = mixing.mix(awkward, F.lit("d"), weights({}, {}, {}), (1, 1), 1).collect()
    assert Counter(r.doc_id for r in found)[2] == 2                 # repeated rows count each
    assert {3, 4, 5}.isdisjoint(r.doc_id for r in found)
    assert all(r.taken == r.n_tokens for r in found)
    assert mixing.mix(no_documents, F.lit("d"), weights({}, {}, {}), (1, 1)).collect() == []


@pytest.mark.parametrize("share", [(1, 3), (2, 3), (7, 5)])
def test_mixture_uses_exactly_its_budget(spark, share):
    docs = corpus(spark, [(f"s{k}", "en" if k % 2 else "de", k + 1, k + 2) for k in range(12)])
    total = sum((k + 1) * (k + 2) for k in range(12))
    found = taken(mixing.mix(docs, F.lit("d"), weights({}, {"en": 3}, {"s3": 5}), share, 2))
    assert sum(found.values()) == min(total * share[0] // share[1], 2 * total)


def test_weight_zero_leaves_out_and_hands_on(spark):
    docs = corpus(spark, [("a1", "en", 10, 10), ("a2", "en", 10, 10), ("a3", "de", 10, 10), ("b1", "en", 10, 10)])
    domain = F.substring("source", 1, 1)
    got = taken(mixing.mix(docs, domain, weights({"b": 0}, {}, {"a2": 0}), (1, 1)))
    assert got == {("a", "en", "a1"): 100, ("a", "de", "a3"): 100}
    half = taken(mixing.mix(docs, domain, weights({}, {"de": 0}, {}), (1, 2)))
    assert sum(n for (d, _, _), n in half.items() if d == "a") == 100 == half["b", "en", "b1"]
    assert ("a", "de", "a3") not in half
    assert mixing.mix(docs, domain, weights({"a": 0, "b": 0}, {}, {}), (1, 1)).collect() == []
