"""Row filters on feature trees and on wide gene-transcript-part tables, and checks that report instead of raising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import cascade_delete, propagate_bounds
from .intervals import overlap_flag
from .tables import checked, written

PART_TYPES = ("five_prime_UTR", "CDS", "three_prime_UTR")


def to_chromosome(df: DataFrame, mapping: DataFrame, chromosome: str) -> DataFrame:
    """Features whose seq is a source name of `chromosome` in mapping(source, name), renamed to it."""
    names = mapping.where(F.col("name") == chromosome).select(F.col("source").alias("seq")).distinct()
    return df.join(names, "seq", "left_semi").withColumn("seq", F.lit(chromosome)).select(*df.columns)


def to_strand(df: DataFrame, strand: str) -> DataFrame:
    if strand not in ("positive", "negative", "both"):
        raise ValueError("strand is positive, negative or both")
    return df.where(F.col("strand").isin(*{"positive": ["+"], "negative": ["-"], "both": ["+", "-"]}[strand]))


def without_exons_and_utrs(df: DataFrame) -> DataFrame:
    return df.where(~F.col("type").isin("exon", "five_prime_UTR", "three_prime_UTR"))


def clean(df: DataFrame) -> DataFrame:
    """Without intervals that end before they start, in the order of seq, start, stop, type, strand."""
    return df.where("stop >= start").orderBy("seq", "start", "stop", "type", "strand")


def min_feature_length(df: DataFrame, types: list[str], least: int) -> DataFrame:
    """Drops short features of the given types, then moves transcript and gene bounds to what is left."""
    if bad := set(types) - set(PART_TYPES) - {"exon"}:
        raise ValueError(f"not part types: {sorted(bad)}")
    return propagate_bounds(df.where(~(F.col("type").isin(*types) & (F.col("stop") - F.col("start") < least))))


def min_gene_length(df: DataFrame, least: int, stored: bool = False) -> DataFrame:
    return cascade_delete(df, df.where((F.col("type") == "gene") & (F.col("stop") - F.col("start") < least)).select("id"), stored)


def valid_genes(df: DataFrame, require_utrs: bool = False, stored: bool = False) -> DataFrame:
    """mRNAs must own a CDS (and both UTRs if asked for); genes need a valid mRNA; what hangs below invalid ones goes."""
    has = lambda t: F.max((F.col("type") == t).cast("int"))
    ok = F.least(has("CDS"), has("five_prime_UTR"), has("three_prime_UTR")) if require_utrs else has("CDS")
    good = df.where(F.col("type").isin(*PART_TYPES)).groupBy(F.col("parent").alias("id")).agg(ok.alias("ok")).where("ok = 1").select("id")
    bad_m = df.where("type = 'mRNA'").join(good, "id", "left_anti").select("id")
    genes_with = df.where("type = 'mRNA'").join(good, "id", "left_semi").select(F.col("parent").alias("id")).distinct()
    bad_g = df.where("type = 'gene'").join(genes_with, "id", "left_anti").select("id")
    return cascade_delete(df, bad_m.unionByName(bad_g), stored)


def filter_predictions(df: DataFrame, types: list[str], min_part: int, min_gene: int, require_utrs: bool = False) -> DataFrame:
    """Short parts, then short genes, then invalid genes."""
    one = written(min_feature_length(df, types, min_part), "long-parts")
    return valid_genes(written(min_gene_length(one, min_gene, True), "long-genes"), require_utrs, True)


def quality_pass(df: DataFrame, flag: str = "quality") -> DataFrame:
    """Drops genes and mRNAs with flag '0' and all below them, then genes that are left without an mRNA."""
    df = written(df, "features")  # read for the edges, the roots and the rows
    one = written(cascade_delete(df, df.where(F.col("type").isin("gene", "mRNA") & (F.col(flag) == "0")).select("id"), True), "passed")
    owners = one.where("type = 'mRNA'").select(F.col("parent").alias("id")).distinct()
    return cascade_delete(one, one.where("type = 'gene'").join(owners, "id", "left_anti").select("id"), True)


def filter_log(df: DataFrame, reason: str) -> DataFrame:
    return df.select("seq", "strand", "gene_id").distinct().withColumn("reason", F.lit(reason))


def apply_filters(wide: DataFrame, log: DataFrame) -> DataFrame:
    return wide.join(log.select("seq", "strand", "gene_id").distinct(), ["seq", "strand", "gene_id"], "left_anti").select(*wide.columns)


def bad_canonical(wide: DataFrame) -> DataFrame:
    """Genes with no or several canonical transcripts."""
    t = wide.select("seq", "strand", "gene_id", "transcript_id", "canonical").distinct()
    return t.groupBy("seq", "strand", "gene_id").agg(F.sum(F.when(F.col("canonical") == "1", 1).otherwise(0)).alias("n")).where("n <> 1").select("seq", "strand", "gene_id").withColumn("reason", F.lit("canonical_transcript"))


def incomplete(wide: DataFrame) -> DataFrame:
    """Genes of which a canonical transcript has fewer than three kinds of parts."""
    t = wide.where("canonical = '1'").groupBy("seq", "strand", "gene_id", "transcript_id").agg(F.count_distinct("feature_type").alias("n"))
    return filter_log(t.where("n < 3"), "incomplete_features")


def overlapping_genes(wide: DataFrame) -> DataFrame:
    g = wide.select("seq", "strand", "gene_id", F.col("gene_start").alias("start"), F.col("gene_stop").alias("stop")).distinct()
    return filter_log(overlap_flag(g).where("has_overlap"), "overlapping_gene")


def overlapping_parts(wide: DataFrame) -> DataFrame:
    p = wide.select("seq", "strand", "gene_id", "transcript_id", F.col("feature_start").alias("start"), F.col("feature_stop").alias("stop"))
    return filter_log(overlap_flag(p, ("seq", "strand", "gene_id", "transcript_id"), width=None).where("has_overlap"), "overlapping_feature")


def filter_features(wide: DataFrame, remove_incomplete: bool = True) -> tuple[DataFrame, DataFrame]:
    """Canonical transcripts of genes that pass all filters, and the log (seq, strand, gene_id, reason, start, stop). Works if nothing is filtered.
    A gene with several spans raises. The wide rows are written first, as every step reads a few columns of them again."""
    wide = written(wide, "wide")
    log = written(bad_canonical(wide), "filtered")
    kept = apply_filters(wide, log).where("canonical = '1'")
    steps = [(overlapping_genes, True), (incomplete, remove_incomplete), (overlapping_parts, True)]
    for step, remove in steps:
        found = written(step(kept), "filtered")  # a few columns of the genes that go; read again by each later step
        log = log.unionByName(found)
        kept = apply_filters(kept, found) if remove else kept
    one = lambda c: checked(F.min(c), F.min(c) == F.max(c), f"a gene has several values of {c}")
    spans = wide.groupBy("seq", "strand", "gene_id").agg(one("gene_start").alias("start"), one("gene_stop").alias("stop"))
    return kept, log.join(spans, ["seq", "strand", "gene_id"])


def _checks(df: DataFrame, checks: dict) -> DataFrame:
    """(check, n_bad) from one aggregation."""
    one = df.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k, c in checks.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks))))


def integrity(wide: DataFrame) -> DataFrame:
    """Eight checks of a wide table (with species): (check, n_bad)."""
    cell, within = ["species", "gene_id", "transcript_id"], lambda a, b: (F.col(f"{a}_start") < F.col(f"{b}_start")) | (F.col(f"{a}_stop") > F.col(f"{b}_stop"))
    rows = {"gene_in_sequence": (F.col("gene_start") < 0) | (F.col("gene_stop") > F.col("sequence_length")), "transcript_in_gene": within("transcript", "gene"), "feature_in_transcript": within("feature", "transcript")}
    of = {"canonical": "transcript_id", "strand": "gene_id", "gene_start": "gene_id", "gene_stop": "gene_id", "transcript_start": "transcript_id", "transcript_stop": "transcript_id"}
    total = lambda c: F.sum(c).cast("long")
    # dealt by gene and transcript once, which serves the counts of keys and those of the cells; only cells meet in windows
    x = wide.withColumn("_c", (F.col("canonical") == "1").cast("int")).repartition(*cell)
    x = x.groupBy(*cell, "seq", "feature_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_c").alias("_c"), *(f(c).alias(k + c) for c in of for f, k in ((F.min, "_lo_"), (F.max, "_hi_"))), *(total(F.when(c, 1).otherwise(0)).alias(k) for k, c in rows.items()))
    x = x.groupBy(*cell).agg(total("_n").alias("_n"), total(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("primary_key_unique"), F.max("_c").alias("_c"), *(f(k + c).alias(k + c) for c in of for f, k in ((F.min, "_lo_"), (F.max, "_hi_"))), *(total(k).alias(k) for k in rows))
    w = {k: Window.partitionBy("species", k) for k in ("gene_id", "transcript_id")}
    varies = lambda c: F.min(f"_lo_{c}").over(w[of[c]]) != F.max(f"_hi_{c}").over(w[of[c]])
    x = x.withColumns({f"_v_{c}": varies(c) for c in of})
    bounds = F.col("_v_gene_start") | F.col("_v_gene_stop") | F.col("_v_transcript_start") | F.col("_v_transcript_stop")
    kinds = {"canonical_consistent": F.col("_v_canonical"), "strand_consistent": F.col("_v_strand"), "bounds_consistent": bounds}
    sums = [*(total(k).alias(k) for k in ("primary_key_unique", *rows)), *(total(F.when(c, F.col("_n")).otherwise(0)).alias(k) for k, c in kinds.items())]
    # species are few, so their sums come from partial ones and a species without a canonical row counts whole
    x = x.groupBy("species").agg(F.max("_c").alias("_c"), total("_n").alias("_n"), *sums).withColumn("species_has_canonical", F.when(F.col("_c") == 0, F.col("_n")).otherwise(0))
    checks = ["primary_key_unique", "species_has_canonical", *kinds, *rows]
    one = x.agg(*(F.coalesce(total(k), F.lit(0).cast("long")).alias(k) for k in checks))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in checks))))


def feature_qc(wide: DataFrame) -> DataFrame:
    """(check, n_bad): nulls in required columns, order of bounds, part inside gene, strand names."""
    nulls = {f"null_{c}": F.col(c).isNull() for c in ("gene_id", "transcript_id", "feature_id", "feature_type", "seq", "strand")}
    return _checks(wide, nulls | {"start_after_stop": F.col("feature_start") > F.col("feature_stop"), "outside_gene": (F.col("feature_start") < F.col("gene_start")) | (F.col("feature_stop") > F.col("gene_stop")), "strand_name": ~F.col("strand").isin("+", "-")})


def label_interval_qc(df: DataFrame, lo: int, hi: int, n_labels: int) -> DataFrame:
    """(check, n_bad) of labelled intervals (group, label, start, stop): order, domain, label range, duplicates, overlaps."""
    w = Window.partitionBy("group", "label", "start", "stop")
    x = overlap_flag(df, ("group", "label")).withColumn("_n", F.count(F.lit(1)).over(w))
    return _checks(x, {"empty_or_reversed": F.col("start") >= F.col("stop"), "outside_domain": (F.col("start") < lo) | (F.col("stop") > hi), "label_range": (F.col("label") < 0) | (F.col("label") >= n_labels), "duplicate": F.col("_n") > 1, "overlap": F.col("has_overlap")})


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    return _checks(df, {f"null_{c}": F.col(c).isNull() for c in cols})


def in_region(df: DataFrame, seq: str, start: int, stop: int) -> DataFrame:
    """Intervals that overlap the half-open region."""
    return df.where((F.col("seq") == seq) & (F.col("start") < stop) & (F.col("stop") > start))


def every_nth(df: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) % step == 0)


def set_column(df: DataFrame, name: str, value: str | None) -> DataFrame:
    """df with a constant in a text column, such as another source."""
    return df.withColumn(name, F.lit(value).cast("string"))
