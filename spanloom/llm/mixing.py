"""Mixing sources to target weights by hierarchical budgets.

Documents hang on a tree (by default domain, language, source).  A token budget is split by weight from the root
down.  A child gets no more than its subtree can give (its tokens times the allowed epochs); what it can't use
goes to its siblings by weight, and only what no sibling can use goes back to the parent's siblings.  Each leaf
then takes whole epochs and, of one more epoch in seeded order, the longest prefix of tokens that its budget holds:
of the document in which the prefix ends, its first tokens.  Every epoch has an order of its own.

Budgets are found level by level in tables of nodes, however many leaves there are.  Prefixes are found without
sorting a leaf: its documents are dealt into buckets by the seeded order itself, bucket sums are accumulated, and
only the one bucket in which the budget ends is ordered.

Nulls in the tree's columns are a value of their own; null and empty texts have no tokens and are taken where they
stand before the end of a prefix; repeated rows are taken each on their own; an empty table or a budget of 0 gives
nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keep, table

LEVELS, SEED, BUCKET_ROWS = ("domain", "lang", "source"), 20240, 1_000
#: Leaf tables up to this size are broadcast to the documents; larger ones are joined by key.
BROADCAST_LEAVES = 100_000
DOMAINS = 4
NULL, ANY = "\u0000", "*"
#: The target weights of the registered query: by node path, where ANY stands for every value of a level above.
TARGETS = {
    ("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0,
    (ANY, "en"): 5.0, (ANY, "de"): 2.0, (ANY, "fr"): 2.0, (ANY, "es"): 1.5,
}


def domain_of(source) -> Column:
    """The domain of a source where documents name none: one of four, by checksum."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit(NULL))), F.lit(DOMAINS)).cast("string"))


def word_count(text) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(weights: Mapping[tuple, float], keys: list[str]) -> Column:
    """A node's target weight: its own, else that of its value under any parent, else 1."""
    out = F.lit(1.0)
    here = [(path, w) for path, w in weights.items() if len(path) == len(keys)]
    for path, w in sorted(here, key=lambda x: -sum(p == ANY for p in x[0])):  # the most general first, so the exact one wins
        fits = F.lit(True)
        for k, p in zip(keys, path):
            fits = fits if p == ANY else fits & (F.col(k) == F.lit(p))
        out = F.when(fits, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, keys: list[str], total_share: float, epochs: int, weights: Mapping[tuple, float]) -> DataFrame:
    """``leaves(*keys, tokens, ...)`` with leaf_budget.

    A parent's amount rises in its children like water in vessels as wide as their weights: with the children in
    order of limit by weight, all up to some child are full, and the others share what is left by weight.
    """
    total = F.least(F.lit(float(total_share)), F.lit(float(epochs))) * F.sum("tokens")
    above = leaves.agg(F.coalesce(total, F.lit(0.0)).alias("_amount"))
    for depth in range(1, len(keys) + 1):
        here, parent = keys[:depth], keys[: depth - 1]
        limit = F.sum("tokens").cast("double") * epochs
        nodes = leaves.groupBy(*here).agg(limit.alias("_limit")).withColumn("_w", _weight(weights, here))
        nodes = nodes.withColumn("_w", F.when(F.col("_limit") > 0, F.greatest("_w", F.lit(0.0))).otherwise(0.0))
        nodes = nodes.join(above, parent) if parent else nodes.join(F.broadcast(above))  # the root is one row
        ratio = F.when(F.col("_w") > 0, F.col("_limit") / F.col("_w"))
        order = Window.partitionBy(*parent, F.lit(0)).orderBy(F.col("_ratio").asc_nulls_last(), here[-1])
        used = F.coalesce(F.sum("_usable").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_ratio", ratio).withColumn("_usable", F.when(F.col("_w") > 0, F.col("_limit")).otherwise(0.0))
        nodes = nodes.withColumn("_height", F.when(F.col("_w") > 0, (F.col("_amount") - used) / rest))
        nodes = nodes.withColumn("_open", F.col("_ratio") > F.col("_height"))
        water = F.max(F.when(F.col("_open"), F.col("_height"))).over(Window.partitionBy(*parent, F.lit(0)))
        given = F.when(F.col("_w") <= 0, 0.0).when(F.col("_open"), F.greatest(water, F.lit(0.0)) * F.col("_w")).otherwise(F.col("_limit"))
        above = nodes.select(*here, given.alias("_amount"))
    return leaves.join(above.withColumnRenamed("_amount", "leaf_budget"), keys).withColumn("leaf_budget", F.floor(F.col("leaf_budget") + 1e-6))


def mix(docs: DataFrame, total_share: float = 1.0, epochs: int = 2, levels: Sequence[str] = LEVELS, weights: Mapping[tuple, float] | None = None, seed: int = SEED) -> DataFrame:
    """What is taken of ``docs(doc_id, *levels, n_tokens)``, a row for each document and epoch.

    leaf_budget is the leaf's budget, taken_tokens how many of the document's first tokens the epoch takes, and
    draw its place: an epoch's stream is its rows in order of draw.  The whole budget is ``total_share`` of the
    tokens there are; ``weights`` are by node path, ANY for any value of a level; a node that has none weighs 1.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(f"_{c}") for c in levels]
    d = keep(docs.select("doc_id", *levels, "n_tokens", *named, F.monotonically_increasing_id().alias("_row")), "mix")
    keys = [f"_{c}" for c in levels]
    leaves = d.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = keep(budgets(keep(leaves, "leaves"), keys, total_share, epochs, weights or {}), "budgets")
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("leaf_budget") / F.col("tokens")))).otherwise(0)
    plan = leaves.select(
        *keys, "leaf_budget", whole.cast("int").alias("_whole"), (F.col("leaf_budget") - whole * F.col("tokens")).alias("_rest"),
        F.greatest(F.lit(1), F.floor(F.col("rows") / BUCKET_ROWS)).cast("long").alias("_buckets"),
        F.xxhash64(*keys).alias("_leaf"),
    )
    d = d.join(F.broadcast(plan) if leaves.count() <= BROADCAST_LEAVES else plan, keys)

    def draw(epoch) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, "doc_id", "_row"), 1)

    columns = ("doc_id", *levels, "n_tokens", "leaf_budget", "epoch", "taken_tokens", "draw", "_row")
    turns = d.where("_whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)))
    turns = turns.withColumns({"taken_tokens": F.col("n_tokens"), "draw": draw(F.col("epoch"))}).select(*columns)
    d = d.where("_rest > 0").withColumn("epoch", F.col("_whole")).withColumn("draw", draw(F.col("epoch")))
    place = F.shiftrightunsigned(F.col("draw"), 32)
    d = d.withColumn("_bucket", F.floor(place * F.col("_buckets") / (1 << 31)).cast("long"))
    sums = d.groupBy("_leaf", *keys, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("_leaf", *keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_leaf", *keys, "_bucket", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    d = d.join(sums, ["_leaf", *keys, "_bucket"])
    inside = F.col("_before") + F.col("_sum") < F.col("_rest")
    in_order = Window.partitionBy("_leaf", *keys, "_bucket").orderBy("draw", "_row").rowsBetween(Window.unboundedPreceding, 0)
    edge = d.where(~inside & (F.col("_before") < F.col("_rest")))
    edge = edge.withColumn("_start", F.col("_before") + F.sum("n_tokens").over(in_order) - F.col("n_tokens")).where("_start < _rest")
    edge = edge.withColumn("taken_tokens", F.least(F.col("n_tokens"), F.col("_rest") - F.col("_start")))
    prefix = d.where(inside).withColumn("taken_tokens", F.col("n_tokens")).select(*columns).unionByName(edge.select(*columns))
    return turns.unionByName(prefix)


def op6_mixing(spark, sf_dir):
    """Every document and epoch taken, with its leaf, tokens, leaf budget, tokens taken and place in the epoch."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    docs = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", word_count(F.col("text")).alias("n_tokens"))
    return mix(docs, weights=TARGETS).drop("_row")
