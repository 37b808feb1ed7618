"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b``) -> one row ``node, root`` per linked node; root is the smallest node.

    Large-star and small-star steps alternate until the set of edges stays as it is. Minima are
    combined before each shuffle, so a node with very many links is no burden for one task.
    """
    edges = written(_ordered(links.select("a", "b")), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        small = _ordered(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                         .unionByName(root.select("a", F.col("m").alias("b"))))
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .filter("a != b").distinct()
