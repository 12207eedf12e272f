"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree has the levels of `levels` (domain, language, source). A node's capacity is the tokens below it times max_epochs.
From the root down, each node's budget is divided among its children in proportion to their weights; what a child cannot
take (its capacity is smaller than its share) goes to its siblings, and only when all siblings are full does it stay above
for the ancestors' other children, because a node never gets more than its subtree holds. This division is exact integer
arithmetic in closed form over one window per sibling group (children ordered by capacity over weight; those before the
water level are full). Each leaf then takes whole seeded epochs of its documents and, of the epoch after them, the longest
prefix (in the order of md5(seed:epoch:doc_id)) whose tokens fit the rest.

A leaf can hold a third of all rows: its prefix is found from token sums of 4,096 hash buckets; only the one bucket that
holds the limit is ordered row by row.

Edge cases: null levels form nodes of their own (named ''); null or empty texts have 0 tokens and are taken if their place is
within the prefix; documents with equal ids are ordered by their tokens and share a place if these are equal too;
an empty table gives no rows; weights that are not given are 1, weights must be positive integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import count_ws_words, fresh, materialize

SEED, MAX_EPOCHS, SHARE = 17, 2, (3, 5)
BUCKET_HEX = 3


def domain_of(source: Column) -> Column:
    """The domain of a source name of the test tables: the remainder of its number."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as bigint)"), F.lit(0)), F.lit(4)).cast("string"))


def weight_of(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out: Column = F.lit(1)
    for k, w in weights.get(level, {}).items():
        out = F.when(name == k, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parent: list[str]) -> DataFrame:
    """children: parent columns, name, w, cap and the parent's budget. Adds the child's own budget as `share`."""
    ratio = (F.col("cap").cast("double") / F.col("w")).alias("r")
    order = [F.col("r"), F.col("name")]
    group = Window.partitionBy(*parent)
    before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: c.cast("decimal(19,0)")
    x = children.withColumn("r", ratio).withColumn("c0", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w0", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    x = x.withColumn("open", d(F.col("cap")) * d(F.col("w0")) > d(F.greatest(F.col("budget") - F.col("c0"), F.lit(0))) * d(F.col("w")))
    x = x.withColumn("open", F.max(F.col("open").cast("int")).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    full = F.coalesce(F.sum(F.when(~F.col("open"), F.col("cap"))).over(group), F.lit(0))
    rest_w = F.sum(F.when(F.col("open"), F.col("w"))).over(group)
    share = F.when(~F.col("open"), F.col("cap")).otherwise(F.floor(d(F.greatest(F.col("budget") - full, F.lit(0))) * d(F.col("w")) / d(rest_w)).cast("long"))
    return x.withColumn("share", F.least(share, F.col("cap"))).drop("r", "c0", "w0", "open")


def leaf_budgets(leaves: DataFrame, levels: list[str], share: tuple[int, int], weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """leaves: levels and tokens of each leaf. Returns them with budget. The root's budget is that share of all tokens."""
    x = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    everything = F.expr("sum(cap) over ()") / F.lit(max_epochs)
    root, budget = F.floor(everything.cast("decimal(19,0)") * share[0] / share[1]).cast("long"), None
    for i, level in enumerate(levels):
        own, parent = levels[: i + 1], levels[:i]
        nodes = x.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("name", F.col(level)).withColumn("w", weight_of(level, F.col(level), weights))
        nodes = nodes.join(budget, parent) if parent else nodes.withColumn("budget", root)
        budget = divide(nodes, parent or [F.lit(0)]).select(*own, F.col("share").alias("budget"))
    return x.join(budget, levels).drop("cap")


def mix(docs: DataFrame, levels: dict[str, Column], share: tuple[int, int] = SHARE, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the levels, n_tokens, budget of its leaf and copies (times it is taken, 0 to max_epochs)."""
    names = list(levels)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()), count_ws_words(F.col(text_col)).alias("n_tokens"))
    rows = materialize(rows, "tokens")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = materialize(leaf_budgets(leaves, names, share, weights or {}, max_epochs), "budgets", True)
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(plan, names).withColumn("place", place).withColumn("bucket", F.substring("place", 1, BUCKET_HEX))
    sums = rows.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("b"))
    before = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("b").over(before), F.lit(0)))
    rows = rows.join(sums, [*names, "bucket"])
    whole = F.col("base") + F.col("b") <= F.col("rest")
    sure = rows.where(whole | (F.col("base") > F.col("rest"))).withColumn("more", whole.cast("int"))
    inside = Window.partitionBy(*names, "bucket").orderBy("place", "n_tokens").rangeBetween(Window.unboundedPreceding, 0)
    edge = rows.where(~whole & (F.col("base") <= F.col("rest"))).withColumn("more", (F.col("base") + F.sum("n_tokens").over(inside) <= F.col("rest")).cast("int"))
    out = sure.unionByName(edge)
    return out.select("doc_id", *names, "n_tokens", "budget", (F.col("epochs") + F.col("more")).alias("copies"))


BROADCAST_ROWS = 500_000


def take(docs: DataFrame, levels: dict[str, Column], share: tuple[int, int] = SHARE, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that a mix with at most one epoch takes, with docs' own columns. Rows that share an id stay together."""
    name = fresh(docs, "_taken")
    taken = mix(docs, levels, share, weights, 1, seed).where("copies > 0").select(F.col("doc_id").alias(name)).distinct()
    taken = materialize(taken, "taken", True)
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)  # counted; above that many rows the join is shuffled
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
