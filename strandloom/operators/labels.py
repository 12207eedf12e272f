"""Base labels as run-length intervals: feature layers, region layers and masks, never one row per base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import complement, merge, nearest, overlap_join

KEYS = ("seq", "strand")


def feature_layers(wide: DataFrame, domain: DataFrame) -> DataFrame:
    """(seq, strand, label, start, stop): each kind of part, introns of genes, and intergenic as what is left of domain(seq, strand, lo, hi)."""
    parts = wide.select(*KEYS, F.col("feature_type").alias("label"), F.col("feature_start").alias("start"), F.col("feature_stop").alias("stop"))
    own = merge(parts, (*KEYS, "label")).select(*KEYS, "label", "start", "stop")
    inner = transcript_introns(wide)
    genes = wide.select(*KEYS, F.col("transcript_start").alias("start"), F.col("transcript_stop").alias("stop"))
    outer = complement(genes, domain, KEYS).select(*KEYS, F.lit("intergenic").alias("label"), "start", "stop")
    return own.unionByName(merge(inner, KEYS).select(*KEYS, F.lit("intron").alias("label"), "start", "stop")).unionByName(outer)


def transcript_introns(wide: DataFrame) -> DataFrame:
    """The places of each transcript span that no part covers, clipped to it."""
    keys = (*KEYS, "transcript_id")
    spans = wide.select(*keys, F.col("transcript_start").alias("lo"), F.col("transcript_stop").alias("hi")).distinct()
    parts = wide.select(*keys, F.col("feature_start").alias("start"), F.col("feature_stop").alias("stop"))
    return complement(parts, spans, keys, width=None)


def region_layers(wide: DataFrame) -> DataFrame:
    """(seq, strand, label, start, stop) with labels gene, transcript, exon, intron and the kinds of parts; regions of one label may overlap."""
    # genes, transcripts and parts from one pass over the rows
    spans = F.array(*(F.struct(label.alias("label"), F.col(f"{a}_start").alias("start"), F.col(f"{a}_stop").alias("stop")) for label, a in ((F.lit("gene"), "gene"), (F.lit("transcript"), "transcript"), (F.col("feature_type"), "feature"))))
    exon = merge(wide.select(*KEYS, "transcript_id", F.col("feature_start").alias("start"), F.col("feature_stop").alias("stop")), (*KEYS, "transcript_id"), width=None)
    exon = exon.select(*KEYS, F.lit("exon").alias("label"), "start", "stop")
    intron = transcript_introns(wide).select(*KEYS, F.lit("intron").alias("label"), "start", "stop")
    return wide.select(*KEYS, F.inline(spans)).unionByName(exon).unionByName(intron).distinct()


def boundary_masks(log: DataFrame, genes: DataFrame, up: int = 944, down: int = 1240, length: DataFrame | None = None) -> DataFrame:
    """(seq, strand, gene_id, reason, start, stop): masked intervals of filtered genes: the gene and its flanks.

    Flanks are `up` bases before and `down` bases after it in reading order, cut at the nearest other gene of the strand."""
    near = nearest(log.select(*KEYS, "gene_id", "reason", "start", "stop"), genes.select(*KEYS, "start", "stop"), KEYS)
    plus = F.col("strand") == "+"
    left, right = F.when(plus, F.lit(up)).otherwise(F.lit(down)), F.when(plus, F.lit(down)).otherwise(F.lit(up))
    a = F.greatest(F.col("start") - left, F.coalesce("upstream_stop", F.lit(0)), F.lit(0))
    b = F.least(F.col("stop") + right, F.coalesce("downstream_start", F.col("stop") + right))
    return near.select(*KEYS, "gene_id", "reason", a.alias("start"), b.alias("stop"))


def reason_masks(log: DataFrame, genes: DataFrame, domain: DataFrame, remove_incomplete: bool = True, up: int = 944, down: int = 1240, partial: str = "incomplete_features") -> DataFrame:
    """(seq, strand, reason, start, stop): what each reason of log(seq, strand, reason, start, stop) masks of domain(seq, strand, lo, hi).

    A filtered gene is masked itself. One of reason `partial` is masked with its flanks, or, if such genes are kept
    (remove_incomplete False), by its flanks alone. Flanks are `up` bases before and `down` bases after it in reading order, cut at the
    nearest other gene and at the domain. Empty masks are left out."""
    if up < 1 or down < 1:
        raise ValueError("flanks must be at least one base")
    one = log.select(*KEYS, "reason", "start", "stop").distinct()
    is_partial = F.col("reason") == partial
    near = nearest(one.where(is_partial), genes.select(*KEYS, "start", "stop"), KEYS).join(domain, [*KEYS])
    plus = F.col("strand") == "+"
    left, right = F.when(plus, F.lit(up)).otherwise(F.lit(down)), F.when(plus, F.lit(down)).otherwise(F.lit(up))
    before = F.struct(F.greatest(F.col("start") - left, "upstream_stop", "lo").alias("a"), F.least("start", "hi").alias("b"))
    after = F.struct(F.greatest("stop", "lo").alias("a"), F.least(F.col("stop") + right, "downstream_start", "hi").alias("b"))
    flanks = near.select(*KEYS, "reason", F.inline(F.array(before, after))).where("a < b").select(*KEYS, "reason", F.col("a").alias("start"), F.col("b").alias("stop"))
    inner = (one if remove_incomplete else one.where(~is_partial)).join(domain, [*KEYS])
    inner = inner.select(*KEYS, "reason", F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop")).where("start < stop")
    return inner.unionByName(flanks).distinct()


def masked_runs(runs: DataFrame, masks: DataFrame, label: str = "label", mask_value: int = -1) -> DataFrame:
    """Label runs (seq, strand, label, start, stop) with every masked stretch cut out and given mask_value."""
    m = merge(masks, KEYS).select(*KEYS, F.col("start").alias("ms"), F.col("stop").alias("me"))
    ends = runs.select(*KEYS, F.col("start").alias("p")).unionByName(runs.select(*KEYS, F.col("stop").alias("p"))).unionByName(m.select(*KEYS, F.col("ms").alias("p"))).unionByName(m.select(*KEYS, F.col("me").alias("p"))).distinct()
    w = Window.partitionBy(*KEYS).orderBy("p")
    cells = ends.select(*KEYS, F.col("p").alias("start"), F.lead("p").over(w).alias("stop")).where("stop is not null")
    own = overlap_join(cells, runs.select(*KEYS, "start", "stop", label)).select(*KEYS, "start", "stop", F.col(f"r_{label}").alias(label))
    hit = overlap_join(cells, m.select(*KEYS, F.col("ms").alias("start"), F.col("me").alias("stop"))).select(*KEYS, "start", "stop", F.lit(True).alias("_m")).distinct()
    x = own.join(hit, [*KEYS, "start", "stop"], "left").withColumn(label, F.when(F.col("_m"), F.lit(mask_value)).otherwise(F.col(label))).drop("_m")
    return merge(x, (*KEYS, label)).select(*KEYS, label, "start", "stop")


def intergenic(values: Column) -> Column:
    """One minus the largest of the other layers' 0/1 values."""
    return 1 - F.array_max(values)


def one_hot_errors(layers: DataFrame, domain: DataFrame) -> DataFrame:
    """Bases of each (seq, strand) covered by no layer or by several: covered and total show which."""
    total = layers.groupBy(*KEYS).agg(F.sum(F.col("stop") - F.col("start")).alias("sum_layers"))
    cover = merge(layers, KEYS).groupBy(*KEYS).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    x = domain.join(total, [*KEYS], "left").join(cover, [*KEYS], "left").fillna(0, ["sum_layers", "covered"])
    return x.select(*KEYS, (F.col("hi") - F.col("lo") - F.col("covered")).alias("uncovered"), (F.col("sum_layers") - F.col("covered")).alias("extra"))

