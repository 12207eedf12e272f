"""Window and tag statistics over datasets: small additive states of batches that merge into a roll-up.

A state is a table (batch, species, chrom, metric, label, n). States of different batches add up; a batch that is written again
replaces its own rows, so a repeated batch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "batch string, species string, chrom string, metric string, label string, n long"
DATASET = ("species", "chrom")


def window_state(windows: DataFrame, batch: Column | str) -> DataFrame:
    """State of windows (species, chrom, kept, intergenic, selected, length): how many were processed, kept, and available and selected of
    either kind, and a sketch of the lengths kept: counts by number of binary digits. One aggregation; a row counts for several labels."""
    kept, chosen, inter = (F.coalesce(F.col(c), F.lit(False)) for c in ("kept", "selected", "intergenic"))
    kind = F.when(inter, F.lit("intergenic")).otherwise(F.lit("genic"))
    mark = lambda metric, label, ok: F.when(ok, F.struct(F.lit(metric).alias("metric"), label.alias("label")))
    digits = F.lpad(F.when(F.col("length") > 0, F.length(F.bin("length"))).otherwise(F.lit(0)).cast("string"), 2, "0")
    marks = F.array_compact(F.array(mark("windows", F.lit("processed"), F.lit(True)), mark("windows", F.when(kept, F.lit("kept")).otherwise(F.lit("skipped")), F.lit(True)), mark("available", kind, kept), mark("selected", kind, kept & chosen), mark("length", digits, kept & F.col("length").isNotNull())))
    x = windows.select((F.lit(batch) if isinstance(batch, str) else batch).alias("batch"), *DATASET, F.explode(marks).alias("m"))
    return x.groupBy("batch", *DATASET, F.col("m.metric").alias("metric"), F.col("m.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def tag_state(tags: DataFrame, batch: Column | str) -> DataFrame:
    """State of tags (species, chrom, tag), one row for each place."""
    x = tags.select((F.lit(batch) if isinstance(batch, str) else batch).alias("batch"), *DATASET, F.lit("tag").alias("metric"), F.col("tag").cast("string").alias("label"))
    return x.groupBy("batch", *DATASET, "metric", "label").agg(F.count(F.lit(1)).alias("n"))


def save(state: DataFrame, path: str) -> None:
    """Puts the state's batches into the table at path, each in place of what was there of it; other batches stay."""
    state.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "metric").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def _levels(state: DataFrame, *more: str) -> DataFrame:
    """Sums by dataset, by species and over all; level says which."""
    cols = [F.col(c) for c in (*DATASET, *more)]
    own = [F.col(c) for c in more]
    x = state.groupingSets([[*cols], [F.col("species"), *own], [*own]], *cols).agg(F.sum("n").alias("n"), F.grouping("species").alias("_s"), F.grouping("chrom").alias("_c"))
    return x.select(F.when(F.col("_s") == 1, "all").when(F.col("_c") == 1, "species").otherwise("dataset").alias("level"), *DATASET, *more, "n")


def window_rollup(states: DataFrame) -> DataFrame:
    """(level, species, chrom, processed, kept, skipped, keep_rate, available_ and selected_ intergenic and genic, available_share,
    selected_share: of intergenic ones, length_from): a row for each dataset, each species and all. At least half of the lengths kept
    are length_from or longer, to the power of two below."""
    x = _levels(states.where(F.col("metric").isin("windows", "available", "selected", "length")), "metric", "label")
    of = lambda metric, label: F.coalesce(F.sum(F.when((F.col("metric") == metric) & (F.col("label") == label), F.col("n"))), F.lit(0))
    sketch = F.array_sort(F.collect_list(F.when(F.col("metric") == "length", F.struct("label", "n"))))  # 64 lengths at most
    counts = {c: of("windows", c) for c in ("processed", "kept", "skipped")} | {f"{m}_{k}": of(m, k) for m in ("available", "selected") for k in ("intergenic", "genic")}
    x = x.groupBy("level", *DATASET).agg(*(v.alias(k) for k, v in counts.items()), sketch.alias("_l"))
    rate = lambda a, b: F.when(b > 0, a / b)
    both = lambda m: F.col(f"{m}_intergenic") + F.col(f"{m}_genic")
    above = lambda k: F.aggregate(F.filter("_l", lambda e: e["label"] >= k), F.lit(0).cast("long"), lambda s, e: s + e["n"])
    total = F.aggregate("_l", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    median = F.array_max(F.filter(F.transform("_l", lambda e: e["label"]), lambda k: above(k) * 2 >= total)).cast("int")
    least = F.when(median > 0, F.call_function("shiftleft", F.lit(1).cast("long"), median - 1)).when(median == 0, F.lit(0).cast("long"))
    return x.select("level", *DATASET, "processed", "kept", "skipped", rate(F.col("kept"), F.col("processed")).alias("keep_rate"), *(c for c in counts if "_" in c), rate(F.col("available_intergenic"), both("available")).alias("available_share"), rate(F.col("selected_intergenic"), both("selected")).alias("selected_share"), least.alias("length_from"))


def tag_rollup(states: DataFrame) -> DataFrame:
    """(level, species, chrom, tag, n, frequency): counts of tags and their share within each dataset, each species and all."""
    x = _levels(states.where("metric = 'tag'"), "label")
    total = x.groupBy(F.col("level").alias("_v"), F.col("species").alias("_s"), F.col("chrom").alias("_c")).agg(F.sum("n").alias("_n"))
    same = (F.col("level") == F.col("_v")) & F.col("species").eqNullSafe(F.col("_s")) & F.col("chrom").eqNullSafe(F.col("_c"))
    return x.join(total, same).select("level", *DATASET, F.col("label").alias("tag"), "n", (F.col("n") / F.col("_n")).alias("frequency"))
