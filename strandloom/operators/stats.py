"""Counts, histograms and rates over feature tables and label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _all():
    return Window.partitionBy(F.lit(0))  # over few aggregated rows only


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """(cols, n, percent), the most frequent first, ties by value."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(_all()))
    return counts.orderBy(F.desc("n"), *cols)


def mask_rate(df: DataFrame, masked: Column, *by: str) -> DataFrame:
    """(by, n, n_masked, mask_rate): the share of rows where `masked` holds, by group; a null does not hold."""
    held = F.coalesce(masked, F.lit(False)).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("n_masked")).withColumn("mask_rate", F.col("n_masked") / F.col("n"))


def children_histogram(df: DataFrame, parent_type: str = "gene", child_type: str = "mRNA") -> DataFrame:
    """(n_children, n_parents), parents without a child included."""
    kids = df.where(F.col("type") == child_type).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    x = df.where(F.col("type") == parent_type).select("id").join(kids, "id", "left")
    return x.groupBy(F.coalesce("c", F.lit(0)).alias("n_children")).agg(F.count(F.lit(1)).alias("n_parents"))


def canonical_rate(df: DataFrame, flag: str = "canonical") -> DataFrame:
    """One row: genes, genes with a canonical mRNA, their share, and mRNAs with a flag that is neither 0 nor 1."""
    m = df.where("type = 'mRNA'").groupBy("parent").agg(F.max((F.col(flag) == "1").cast("int")).alias("c"), F.sum(F.when(F.col(flag).isNotNull() & ~F.col(flag).isin("0", "1"), 1).otherwise(0)).alias("odd"))
    x = df.where("type = 'gene'").join(m.withColumnRenamed("parent", "id"), "id", "left")
    n = F.count(F.lit(1))
    return x.agg(n.alias("n_genes"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_canonical"), F.coalesce(F.sum("odd"), F.lit(0)).cast("long").alias("n_unexpected")).withColumn("rate", F.when(F.col("n_genes") > 0, F.col("n_canonical") / F.col("n_genes")).otherwise(F.lit(0.0)))


def type_combinations(df: DataFrame) -> DataFrame:
    """(types, n_transcripts): the sorted set of part types of each mRNA."""
    x = df.where("type not in ('gene', 'mRNA')").groupBy("parent").agg(F.concat_ws(", ", F.array_sort(F.collect_set("type"))).alias("types"))
    return x.groupBy("types").agg(F.count(F.lit(1)).alias("n_transcripts"))


def pivot_counts(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    """Counts by row key with a column for each value, 0 where there are none."""
    return df.groupBy(rows).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def grouped_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts by each of the columns alone, in one pass over grouping sets: (dimension, value, n)."""
    sets = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    x = sets.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols))))
    return x.groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def run_frequency(runs: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """Positions of each label by group, from run lengths: (by, label, n, share)."""
    x = runs.groupBy(*by, label).agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else _all()))


def class_weights(counts: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Inverse-frequency weights of (label, n) that sum to one; a missing count is taken as the smallest."""
    w = _all()
    x = counts.withColumn("n", F.coalesce("n", F.min("n").over(w)))
    x = x.withColumn("inverse", 1.0 / F.greatest(F.col("n") / F.sum("n").over(w), F.lit(floor)))
    return x.withColumn("weight", F.col("inverse") / F.sum("inverse").over(w)).drop("inverse")


def length_distribution(df: DataFrame, by: str, longest: int, shortest: int = 0) -> DataFrame:
    """(by, length, p): share of each length, lengths over `longest` counted as it, those under `shortest` left out."""
    x = df.withColumn("length", F.least(F.col("stop") - F.col("start"), F.lit(longest))).where(F.col("length") >= shortest)
    x = x.groupBy(by, "length").agg(F.count(F.lit(1)).alias("n"))
    return x.select(by, "length", (F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("p"))


def smooth(dist: DataFrame, by: str, sigma: float, longest: int) -> DataFrame:
    """Gaussian smoothing of a length distribution, renormalised; each length sends its share to its neighbours within 3 sigma."""
    reach = int(3 * sigma + 0.5)
    k = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    x = dist.withColumn("d", k).withColumn("p", F.col("p") * F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))).withColumn("length", F.col("length") + F.col("d")).where(F.col("length").between(0, longest))
    x = x.groupBy(by, "length").agg(F.sum("p").alias("p"))
    return x.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(by)))


def issues(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(metrics' row, issue) for each rule that holds; no rows if all is well."""
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return metrics.withColumn("issue", F.explode(found))


def best_row(df: DataFrame, by: list[str], score: str, largest: bool = True, ties: list[str] | None = None) -> DataFrame:
    """The row with the best score of each group, null scores left out; ties by the given columns, ascending."""
    order = [F.col(score).desc() if largest else F.col(score).asc(), *(ties or [])]
    return df.where(F.col(score).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def closest(df: DataFrame, epoch: int, step: int) -> DataFrame:
    """The row nearest to (epoch, step), an epoch weighing a million steps."""
    return df.orderBy(F.abs(F.col("epoch") - epoch) * 1_000_000 + F.abs(F.col("step") - step), "epoch", "step").limit(1)


def missed_novel(df: DataFrame) -> DataFrame:
    """Percentages from counts missed of n_true and novel of n_pred, and F1 from sensitivity and precision in percent."""
    r = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b)).otherwise(F.lit(0.0))
    s, p = F.col("sensitivity"), F.col("precision")
    return df.withColumn("missed_percent", r("missed", "n_true")).withColumn("novel_percent", r("novel", "n_pred")).withColumn("f1", F.when(s + p > 0, 2 * s * p / (s + p)).otherwise(F.lit(0.0)))


def masked_bincount(df: DataFrame, n_labels: int, mask: str, label: str = "label") -> DataFrame:
    """(label, n, n_masked) of each label from 0 below n_labels, and of all other values as label -1. Tables of batches add up: see added()."""
    name = F.when(F.col(label).between(0, n_labels - 1), F.col(label)).otherwise(-1).cast("int")
    counts = df.groupBy(name.alias("label")).agg(F.count_if(F.col(mask)).alias("n"), F.count_if(~F.coalesce(F.col(mask), F.lit(False))).alias("n_masked"))
    every = df.sparkSession.range(-1, n_labels).select(F.col("id").cast("int").alias("label"))
    return every.join(counts, "label", "left").fillna(0, ["n", "n_masked"])


def added(tables: list[DataFrame], by: list[str]) -> DataFrame:
    """Sum of the number columns of tables with the same columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*by).agg(*(F.sum(c).alias(c) for c in out.columns if c not in by))


def terminal_codons(df: DataFrame, by: list[str], dna: str = "dna") -> DataFrame:
    """(by, kind, codon, n): first and last three bases of coding sequences; those with fewer are left out."""
    x = df.where(F.length(dna) >= 3)
    ends = F.array(F.struct(F.lit("start").alias("kind"), F.upper(F.substring(dna, 1, 3)).alias("codon")), F.struct(F.lit("stop").alias("kind"), F.upper(F.substring(dna, -3, 3)).alias("codon")))
    return x.select(*by, F.inline(ends)).groupBy(*by, "kind", "codon").agg(F.count(F.lit(1)).alias("n"))


def mean_scores(scores: DataFrame, by: list[str], threshold: float = 0.5, score: str = "score") -> DataFrame:
    """(by, score, accepted): the mean over models, and whether it reaches the threshold."""
    return scores.groupBy(*by).agg(F.avg(score).alias("score")).withColumn("accepted", F.col("score") >= threshold)


def mean_pool(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, vector): the mean of each group's vectors, such as a protein's from those of its residues. Sums are partial by place."""
    x = vectors.select(*by, F.posexplode(vector).alias("_d", "_v")).groupBy(*by, "_d").agg(F.avg("_v").alias("_v"))
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda p: p["_v"]).alias(vector))  # a vector's places
