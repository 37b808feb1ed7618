"""Mixing sources to target weights.

Weights stand on a tree domain > language > source. A node's token budget goes to its children in
proportion to their weights. What a child cannot use (its tokens times the permitted epochs) goes
to its siblings first, and only what the whole subtree cannot use stays with the level above. Every
leaf then takes a token prefix of its documents, repeated in epochs that are each shuffled by seed.
All arithmetic is on whole numbers, so the same budget gives the same plan everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import hash60, text_of, written

LEVELS = ("domain", "lang", "source")
WORDS = r"[^ \t-\r]+"
BUCKETS = 1 << 14       # hash ranges of a leaf; only the range that the prefix ends in is sorted


def token_count(text: str) -> Column:
    """Words between ASCII white space; zero for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def weight_of(weights: dict[str, int], column: str, default: int) -> Column:
    """The weight of a name; names that are not listed get ``default``."""
    chosen = F.lit(default)
    for name, weight in weights.items():
        chosen = F.when(F.col(column) == name, weight).otherwise(chosen)
    return chosen.cast("long")


def _shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits ``budget`` of each parent over its children: ``cap``, ``weight`` -> ``tokens``.

    Children with the least room for their weight fill up first; the rest is shared by weight with
    cumulative rounding, so the shares add up and none exceeds its room. A child of weight 0 has no room.
    """
    whole = "decimal(38,0)"
    cap, weight = F.col("cap").cast(whole), F.col("weight").cast(whole)
    order = W.partitionBy(*parent).orderBy(F.expr("cap / nullif(weight, 0)"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    nodes = nodes.withColumns({
        "_room": F.col("budget").cast(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "_weights": F.sum(weight).over(after)})
    nodes = nodes.withColumn("_full", cap * F.col("_weights") <= weight * F.col("_room"))
    every = W.partitionBy(*parent)
    open_ = ~F.col("_full")
    nodes = nodes.withColumns({
        "_rest": F.col("budget").cast(whole) - F.coalesce(
            F.sum(F.when(F.col("_full"), cap)).over(every), F.lit(0)),
        "_all": F.sum(F.when(open_, weight)).over(every),
        "_upto": F.sum(F.when(open_, weight).otherwise(0)).over(
            order.rowsBetween(W.unboundedPreceding, 0))})
    part = "cast((_rest * {0}) div _all as bigint)"
    share = F.expr(part.format("_upto")) - F.expr(part.format(f"(_upto - cast(weight as {whole}))"))
    return nodes.withColumn("tokens", F.when(F.col("_full"), F.col("cap")).otherwise(share)) \
        .drop("_room", "_weights", "_full", "_rest", "_all", "_upto")


def budgets(leaves: DataFrame, weights: dict[str, Column], share: tuple[int, int],
            max_epochs: int) -> DataFrame:
    """The tokens of each leaf: ``domain, lang, source, capacity, tokens``.

    ``leaves`` has the ``capacity`` (tokens of one epoch) of each leaf. The budget of the root is
    ``share`` (a fraction as two numbers) of all tokens, at most all epochs of what has a weight.
    """
    def weighed(nodes: DataFrame, level: str) -> DataFrame:
        nodes = nodes.withColumn("weight", weights[level])
        return nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))

    leaves = weighed(leaves.withColumn("cap", F.col("capacity") * max_epochs), "source")
    langs = weighed(leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")), "lang")
    domains = weighed(langs.groupBy("domain").agg(F.sum("cap").alias("cap")), "domain")
    most = leaves.agg(F.sum("capacity")).first()[0] or 0
    root = min(most * share[0] // share[1], domains.agg(F.sum("cap")).first()[0] or 0)
    spent = F.col("tokens").alias("budget")
    level = _shares(domains.withColumns({"budget": F.lit(root).cast("long"), "_root": F.lit(0)}), ["_root"], "domain")
    level = _shares(langs.join(level.select("domain", spent), "domain"), ["domain"], "lang")
    level = _shares(leaves.join(level.select("domain", "lang", spent), ["domain", "lang"]), ["domain", "lang"], "source")
    return level.select(*LEVELS, "capacity", "tokens")


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], share: tuple[int, int],
        max_epochs: int = 1, seed: str = "0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, domain, lang, source, n_tokens, epoch, taken`` of the chosen documents.

    A document occurs once per epoch that takes it; ``taken`` is less than ``n_tokens`` only where a
    leaf's prefix ends. Documents without words, and null names (a leaf called "") are treated like
    all others; a document of no words is never taken. Repeated rows of one key count each and are
    taken in turn, as one run in the order; ties in the hash go by key. An empty table gives no row.
    """
    name = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("lang", "source")}
    rows = docs.select(
        F.col(f"`{key}`").alias(key), domain.alias("domain"), name["lang"].alias("lang"),
        name["source"].alias("source"), token_count(f"`{text}`").alias("n_tokens")) \
        .filter("n_tokens > 0")
    leaf = list(LEVELS)
    leaves = written(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("capacity")), "leaves")
    plan = budgets(leaves, weights, share, max_epochs).filter("tokens > 0") \
        .withColumns({"whole": F.expr("tokens div capacity"), "part": F.expr("tokens % capacity")})
    rows = rows.groupBy(key, *leaf, "n_tokens").agg(F.count("*").alias("copies")) \
        .join(plan, leaf)

    out = [key, *leaf, "n_tokens"]
    full = rows.filter("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)"))) \
        .withColumn("taken", F.col("n_tokens"))
    full = full.withColumn("copies", F.col("copies").cast("int")).select(*out, "epoch", "taken", "copies")

    last = rows.filter("part > 0").withColumn("epoch", F.col("whole"))
    last = last.withColumn("_order", hash60(F.concat_ws(":", F.lit(seed), F.col("epoch"), text_of(key))))
    last = last.withColumn("_range", F.expr(f"_order div {(1 << 60) // BUCKETS}"))
    ranges = last.groupBy(*leaf, "part", "_range").agg(F.sum(F.expr("n_tokens * copies")).alias("_sum"))
    upto = W.partitionBy(*leaf).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))) \
        .filter("_before < part")
    last = last.join(ranges.select(*leaf, "_range", "_before", "_sum"), [*leaf, "_range"])
    inside = F.col("_before") + F.col("_sum") <= F.col("part")
    within = W.partitionBy(*leaf, "_range").orderBy("_order", key, "n_tokens") \
        .rowsBetween(W.unboundedPreceding, -1)
    cut = last.filter(~inside).withColumn("_start", F.col("_before") + F.coalesce(
        F.sum(F.expr("n_tokens * copies")).over(within), F.lit(0))).filter("_start < part")
    # Copies of one row stand in a run: some are taken whole, and the last one in part.
    cut = cut.withColumn("_room", F.least(F.expr("part - _start"), F.expr("n_tokens * copies")))
    pieces = cut.withColumns({"_whole": F.expr("_room div n_tokens"), "_part": F.expr("_room % n_tokens")})
    one = F.lit(1)
    return full.unionByName(last.filter(inside).select(
        *out, "epoch", F.col("n_tokens").alias("taken"), F.col("copies").cast("int").alias("copies"))) \
        .unionByName(pieces.filter("_whole > 0").select(
            *out, "epoch", F.col("n_tokens").alias("taken"), F.col("_whole").cast("int").alias("copies"))) \
        .unionByName(pieces.filter("_part > 0").select(
            *out, "epoch", F.col("_part").alias("taken"), one.alias("copies"))) \
        .withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).drop("copies", "_copy")
