"""Feature trees as rows (id, parent, type, seq, strand, start, stop, row), row being the file order; coordinates half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import gaps, merge
from .tables import checked, written

GENERATIONS = 3  # that one plan finds: features have parts of parts, seldom more


def cascade_delete(df: DataFrame, roots: DataFrame, stored: bool = False) -> DataFrame:
    """df without the features of roots(id) and all their descendants. See removed() for what goes.

    What has an id and a parent that goes is gone itself, so the parent is only asked for where there is no id. stored: df is a written table."""
    gone = removed(df, roots, stored).select(F.col("id").alias("_gone"))
    return df.join(gone, F.coalesce("id", "parent") == F.col("_gone"), "left_anti").select(*df.columns)


def removed(df: DataFrame, roots: DataFrame, stored: bool = False) -> DataFrame:
    """(id, direct): ids that go, direct being whether the id is in roots. Semi joins over the written (id, parent) table find
    GENERATIONS at a time, written as one table, until the last of them has no id that isn't gone already, so a parent cycle ends too."""
    edges = df.where("id is not null").select("id", "parent")
    edges = edges if stored else written(edges, "edges")
    out = written(edges.join(roots.select("id").distinct(), "id", "left_semi").select("id").distinct().withColumn("depth", F.lit(0)), "front")
    front, direct = out, F.col("depth") == 0
    while True:
        known, found = out.select("id"), None
        for k in range(1, GENERATIONS + 1):
            front = edges.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct().join(known, "id", "left_anti").withColumn("depth", F.lit(k))
            known, found = known.unionByName(front.select("id")), front if found is None else found.unionByName(front)
        found = written(found, "front")
        front = found.where(F.col("depth") == GENERATIONS)
        out = out.unionByName(found)
        if front.isEmpty():
            return out.select("id", direct.alias("direct"))
        out = written(out, "removed")


def expand_parents(df: DataFrame) -> DataFrame:
    """A row for each parent of a comma-separated parent list."""
    return df.withColumn("parent", F.explode_outer(F.split("parent", ",")))


def attach_orphans(df: DataFrame) -> DataFrame:
    """Adds an inferred_parent row for each missing parent of several children; a single orphan becomes a top-level feature."""
    known = df.select("id").where("id is not null").distinct()
    orphan = df.where("parent is not null").join(known.withColumnRenamed("id", "parent"), "parent", "left_anti")
    groups = orphan.groupBy("parent", "seq").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("strand").alias("s1"), F.max("strand").alias("s2"), F.count(F.lit(1)).alias("n"))
    made = groups.where("n > 1").select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("inferred_parent").alias("type"), "seq", F.when(F.col("s1") == F.col("s2"), F.col("s1")).alias("strand"), "start", "stop")
    single = groups.where("n = 1").select("parent", "seq", F.lit(True).alias("_single"))
    rest = df.join(single, ["parent", "seq"], "left").withColumn("parent", F.when(F.col("_single"), F.lit(None)).otherwise(F.col("parent"))).drop("_single").select(*df.columns)
    return rest.unionByName(made, allowMissingColumns=True)


def remap_duplicate_ids(df: DataFrame) -> DataFrame:
    """Rows with one id get _2, _3, ... in file order; a child goes to the first of its parents' rows that contains it. A child whose
    parent's id is repeated and none of whose rows contains it raises."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    new_id = lambda k: F.when(k > 1, F.concat_ws("_", "id", k)).otherwise(F.col("id"))
    named = df.withColumn("_k", n).withColumn("_new", F.when(F.col("id").isNotNull(), new_id(F.col("_k"))))
    parents = named.where("id is not null").select(F.col("id").alias("parent"), F.col("_new").alias("_p"), F.col("_k").alias("_pk"), F.col("start").alias("_ps"), F.col("stop").alias("_pe"), F.col("seq").alias("_pq"))
    hit = named.join(parents, "parent").where((F.col("_ps") <= F.col("start")) & (F.col("_pe") >= F.col("stop")) & (F.col("_pq") == F.col("seq")))
    first = hit.withColumn("_o", F.row_number().over(Window.partitionBy("row").orderBy("_pk"))).where("_o = 1").select("row", "_p")
    several = named.where("_k = 2 and id is not null").select(F.col("id").alias("parent"), F.lit(True).alias("_several"))
    x = named.join(first, "row", "left").join(several, "parent", "left")
    found = checked(F.coalesce("_p", "parent"), F.col("_p").isNotNull() | F.col("_several").isNull(), F.concat(F.lit("no parent contains the child of "), "parent"))
    return x.withColumn("parent", found).withColumn("id", F.col("_new")).select(*df.columns)


def representative(df: DataFrame, mode: str = "longest", flag: str = "canonical", allowed: tuple[str, ...] = ("", "0", "1")) -> DataFrame:
    """(id, parent): one mRNA for each known gene. longest: by length; annotated: flagged ones ('1') first, then by length, and an error
    if there is no flag column; annotated_or_longest: annotated where the column exists, else longest. A flag that is neither null nor
    allowed raises. Ties go to the first row of the file."""
    if mode not in ("longest", "annotated", "annotated_or_longest"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "annotated" and flag not in df.columns:
        raise ValueError(f"no column {flag}")
    genes = df.where("type = 'gene'").select(F.col("id").alias("parent")).distinct()
    m = df.where("type = 'mRNA'").join(genes, "parent", "left_semi")
    order = [(F.col("stop") - F.col("start")).desc(), F.col("row")]
    if mode != "longest" and flag in df.columns:
        known = F.col(flag).isNull() | F.col(flag).isin(*allowed)
        order.insert(0, checked(F.coalesce(F.col(flag) == "1", F.lit(False)), known, F.concat(F.lit(f"invalid value of {flag}: "), flag)).desc())
    return m.withColumn("_k", F.row_number().over(Window.partitionBy("parent").orderBy(*order))).where("_k = 1").select("id", "parent")


def keep_representative(df: DataFrame, mode: str = "longest", flag: str = "canonical", allowed: tuple[str, ...] = ("", "0", "1")) -> DataFrame:
    """df with the genes that have a representative, that mRNA and its parts."""
    best = representative(df, mode, flag, allowed)
    keep = best.select("id").unionByName(best.select(F.col("parent").alias("id"))).distinct()
    top = df.where("type in ('gene', 'mRNA')").join(keep, "id", "left_semi")
    parts = df.where("type not in ('gene', 'mRNA')").join(best.select(F.col("id").alias("parent")), "parent", "left_semi")
    return top.unionByName(parts.select(*top.columns)).select(*df.columns)


def propagate_bounds(df: DataFrame) -> DataFrame:
    """mRNA bounds become those of their parts and gene bounds those of their mRNAs; features without children keep theirs."""
    bounds = lambda x: x.groupBy(F.col("parent").alias("id")).agg(F.min("start").alias("_s"), F.max("stop").alias("_e"))
    fit = lambda x, of: x.join(of, "id", "left").withColumns({"start": F.coalesce("_s", "start"), "stop": F.coalesce("_e", "stop")}).select(*df.columns)
    m = fit(df.where("type = 'mRNA'"), bounds(df.where("type not in ('gene', 'mRNA')")))
    # parts keep their bounds, so they are not joined to anything
    rest = df.where(~F.coalesce(F.col("type").isin("gene", "mRNA"), F.lit(False)))
    return rest.unionByName(m).unionByName(fit(df.where("type = 'gene'"), bounds(m)))


def flatten(df: DataFrame, parts=("five_prime_UTR", "CDS", "three_prime_UTR"), strict: bool = True) -> DataFrame:
    """Wide rows gene, transcript, part; sequence_length is the largest stop of a top-level feature of the sequence. Exons are skipped;
    strict: any other type raises."""
    if strict:
        df = df.withColumn("type", checked(F.col("type"), F.col("type").isin("gene", "mRNA", "exon", *parts), F.concat(F.lit("unknown feature type "), F.coalesce("type", F.lit("null")))))
    g = df.where("type = 'gene'").select(F.col("id").alias("gene_id"), "seq", "strand", F.col("start").alias("gene_start"), F.col("stop").alias("gene_stop"))
    m = df.where("type = 'mRNA'").select(F.col("id").alias("transcript_id"), F.col("parent").alias("gene_id"), F.col("start").alias("transcript_start"), F.col("stop").alias("transcript_stop"), *([F.col("canonical")] if "canonical" in df.columns else []))
    p = df.where(F.col("type").isin(*parts)).select(F.col("id").alias("feature_id"), F.col("parent").alias("transcript_id"), F.col("type").alias("feature_type"), F.col("start").alias("feature_start"), F.col("stop").alias("feature_stop"))
    length = df.where("parent is null").groupBy("seq").agg(F.max("stop").alias("sequence_length"))
    return g.join(m, "gene_id").join(p, "transcript_id").join(length, "seq")


def stack(wide: DataFrame) -> DataFrame:
    """Long rows (level, path, id, type, seq, strand, start, stop) at gene, transcript and part level, each once; path: ancestors' ids."""
    one = wide.select(F.lit(0).alias("level"), F.array("seq").alias("path"), F.col("gene_id").alias("id"), F.lit("gene").alias("type"), "seq", "strand", F.col("gene_start").alias("start"), F.col("gene_stop").alias("stop")).distinct()
    two = wide.select(F.lit(1).alias("level"), F.array("seq", "gene_id").alias("path"), F.col("transcript_id").alias("id"), F.lit("mRNA").alias("type"), "seq", "strand", F.col("transcript_start").alias("start"), F.col("transcript_stop").alias("stop")).distinct()
    three = wide.select(F.lit(2).alias("level"), F.array("seq", "gene_id", "transcript_id").alias("path"), F.col("feature_id").alias("id"), F.col("feature_type").alias("type"), "seq", "strand", F.col("feature_start").alias("start"), F.col("feature_stop").alias("stop")).distinct()
    return one.unionByName(two).unionByName(three)


def derive_utrs(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """UTR parts (parent, type, strand, start, stop) of exons outside the CDS range of their transcript, named by strand."""
    r = cds.groupBy("parent").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    x = exons.join(r, "parent")
    low = x.select("parent", F.when(F.col("strand") == "-", "three_prime_UTR").otherwise("five_prime_UTR").alias("type"), "strand", "start", F.least("stop", "lo").alias("stop"))
    high = x.select("parent", F.when(F.col("strand") == "-", "five_prime_UTR").otherwise("three_prime_UTR").alias("type"), "strand", F.greatest("start", "hi").alias("start"), "stop")
    return low.unionByName(high).where("start < stop")


def transcript_exons(parts: DataFrame) -> DataFrame:
    """Exons (parent, seq, strand, start, stop) of each transcript: merged CDS and UTR parts, or its exon rows if the table has any exon row."""
    flag = parts.agg(F.max((F.col("type") == "exon").cast("int")).alias("f"))
    keys = ("parent", "seq", "strand")
    built = merge(parts.where(F.col("type").isin("CDS", "five_prime_UTR", "three_prime_UTR")), keys, width=None).select(*keys, "start", "stop")
    explicit = parts.where("type = 'exon'").select(*keys, "start", "stop")
    return explicit.withColumn("f", F.lit(1)).unionByName(built.withColumn("f", F.lit(0))).join(F.broadcast(flag.withColumn("f", F.coalesce("f", F.lit(0)))), "f").drop("f")  # one row


def introns(exons: DataFrame) -> DataFrame:
    return gaps(exons, ("parent", "seq", "strand"), width=None)


def interval_sets(parts: DataFrame) -> DataFrame:
    """(parent, cds, utr, exon, intron, intron_cds): sorted distinct interval arrays of each transcript, exon rows ignored."""
    keys = ("parent",)
    p = parts.where(F.col("type").isin("CDS", "five_prime_UTR", "three_prime_UTR")).select("parent", "type", "start", "stop")
    cds, exon = merge(p.where("type = 'CDS'"), keys, width=None), merge(p, keys, width=None)
    kinds = p.where("type = 'CDS'").select("parent", F.lit("cds").alias("kind"), "start", "stop").unionByName(p.where("type <> 'CDS'").select("parent", F.lit("utr").alias("kind"), "start", "stop"))
    for name, x in (("exon", exon), ("intron", gaps(exon, keys, width=None)), ("intron_cds", gaps(cds, keys, width=None))):
        kinds = kinds.unionByName(x.select("parent", F.lit(name).alias("kind"), "start", "stop"))
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.struct("start", "stop")))).alias(k)  # noqa: E731  the parts of one transcript
    return kinds.groupBy("parent").agg(*(pick(k) for k in ("cds", "utr", "exon", "intron", "intron_cds")))


def longest_transcript(df: DataFrame) -> DataFrame:
    """(gene, transcript, bases): the mRNA with the most CDS and UTR bases of each gene; ties to the first row."""
    size = df.where(F.col("type").isin("CDS", "five_prime_UTR", "three_prime_UTR")).groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))
    m = df.where("type = 'mRNA'").join(size, "id", "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    return m.withColumn("_k", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("bases"), "row"))).where("_k = 1").select(F.col("parent").alias("gene"), F.col("id").alias("transcript"), "bases")


def cds_phase(cds: DataFrame) -> DataFrame:
    """cds with its phase: bases before it in reading order, negated, modulo three."""
    order = F.when(F.col("strand") == "-", -F.col("stop")).otherwise(F.col("start"))
    w = Window.partitionBy("parent").orderBy(order, "start", "row").rowsBetween(Window.unboundedPreceding, -1)
    return cds.withColumn("phase", F.pmod(-F.coalesce(F.sum(F.col("stop") - F.col("start")).over(w), F.lit(0)), F.lit(3)).cast("int"))


def segments(exons: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(parent, state, start, stop) covering each transcript: exon and intron segments to its ends."""
    keys = ("parent",)
    e = merge(exons, keys, width=None).select("parent", F.lit("exon").alias("state"), "start", "stop")
    from .intervals import complement

    i = complement(exons.select("parent", "start", "stop"), transcripts.select(F.col("id").alias("parent"), F.col("start").alias("lo"), F.col("stop").alias("hi")), keys, width=None).select("parent", F.lit("intron").alias("state"), "start", "stop")
    return e.unionByName(i)


def group_parts(intervals: DataFrame, min_length: int) -> DataFrame:
    """Parts of predicted transcripts: intervals (seq, strand, entity, start, stop) inside a transcript interval of their strand,
    with that transcript's number in start order. Lengths are true lengths."""
    from .intervals import overlap_join

    t = intervals.where("entity = 'transcript'").where(F.col("stop") - F.col("start") >= min_length)
    t = t.withColumn("gene", F.row_number().over(Window.partitionBy("seq").orderBy("start", "stop", "strand")))
    parts = intervals.where("entity <> 'transcript'")
    x = overlap_join(t.select("seq", "strand", "start", "stop", "gene"), parts.select("seq", "strand", "start", "stop", "entity"), how="contains")
    return x.select("seq", "strand", "gene", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"), F.col("r_entity").alias("entity"), F.col("r_start").alias("start"), F.col("r_stop").alias("stop"))


def emit_features(groups: DataFrame, strip_introns: bool = True) -> DataFrame:
    """GFF-like rows (id, parent, type, seq, strand, start, stop, phase) from group_parts: a gene and an mRNA for each group with CDS or
    UTR parts, bounded by these, and the parts, numbered by type in genomic order. Without strip_introns a group that begins or ends
    with an intron raises."""
    if not strip_introns:
        w = Window.partitionBy("seq", "gene")
        inner = F.when(F.col("entity") != "intron", F.col("start")), F.when(F.col("entity") != "intron", F.col("stop"))
        inside = (F.col("entity") != "intron") | ((F.col("start") > F.min(inner[0]).over(w)) & (F.col("stop") < F.max(inner[1]).over(w)))
        x = groups.where(F.col("entity").isin("CDS", "five_prime_UTR", "three_prime_UTR", "intron")).withColumn("_in", inside)
        bad = F.max(F.coalesce(~F.col("_in"), F.lit(True))).over(w)
        groups = x.withColumn("start", checked(F.col("start"), ~bad, "a gene has terminal introns")).drop("_in")
    p = groups.where(F.col("entity").isin("CDS", "five_prime_UTR", "three_prime_UTR"))
    gid = F.concat(F.col("seq"), F.lit(".gene_"), F.col("gene").cast("string"))
    p = p.withColumn("gid", gid).withColumn("tid", F.concat("gid", F.lit(".t1")))
    k = F.row_number().over(Window.partitionBy("tid", "entity").orderBy("start", "stop"))
    parts = p.select(F.concat_ws(".", "tid", "entity", k).alias("id"), F.col("tid").alias("parent"), F.col("entity").alias("type"), "seq", "strand", "start", "stop")
    bounds = p.groupBy("gid", "tid", "seq", "strand").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    genes = bounds.select(F.col("gid").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("gene").alias("type"), "seq", "strand", "start", "stop")
    mrna = bounds.select(F.col("tid").alias("id"), F.col("gid").alias("parent"), F.lit("mRNA").alias("type"), "seq", "strand", "start", "stop")
    cds = cds_phase(parts.where("type = 'CDS'").withColumn("row", F.lit(0))).drop("row")
    return genes.unionByName(mrna).unionByName(parts.where("type <> 'CDS'")).withColumn("phase", F.lit(None).cast("int")).unionByName(cds)

