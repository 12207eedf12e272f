"""Commands over feature and sequence files: python -m strandloom <command> --help.

Each reads files with Spark, applies one operator and writes GFF3, TSV or Parquet. The session is the one spark-submit gives, or a
local one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, hierarchy
from .plans import pipelines
from .sources import fasta, files, gff, reports


def mapping(spark: SparkSession, pairs: str) -> DataFrame:
    """source:name pairs, separated by commas."""
    return spark.createDataFrame([tuple(x.strip() for x in p.split(":", 1)) for p in pairs.split(",")], "source string, name string")


def representatives(df: DataFrame, mode: str) -> DataFrame:
    """Genes with their one representative transcript and its parts; other rows above or beside genes stay."""
    flagged = df.withColumn("canonical", F.coalesce(F.try_element_at("attrs", F.lit("canonical")), F.lit("")))
    chosen = hierarchy.representative(flagged, mode).select("id")
    others = df.where("type = 'mRNA'").join(chosen, "id", "left_anti").select("id")
    return hierarchy.cascade_delete(df, others)


#: Commands that turn one feature table into another: (help, arguments, function of the table, the arguments and the session).
FEATURE_COMMANDS = {
    "filter-chromosome": ("one chromosome, by its source names", ["--chromosome", "--map"], lambda df, a, s: filters.to_chromosome(df, mapping(s, a.map), a.chromosome)),
    "filter-strand": ("one strand: positive, negative or both", ["--strand"], lambda df, a, s: filters.to_strand(df, a.strand)),
    "set-source": ("another source column", ["--source"], lambda df, a, s: filters.set_column(df, "source", a.source)),
    "remove-exons-utrs": ("without exons and UTRs", [], lambda df, a, s: filters.without_exons_and_utrs(df)),
    "clean": ("without rows that end before they start, sorted", [], lambda df, a, s: filters.clean(df)),
    "representatives": ("one transcript of each gene: longest, annotated or annotated_or_longest", ["--mode"], lambda df, a, s: representatives(df, a.mode)),
    "filter-predictions": ("without short parts, short genes and genes without coding parts", ["--min-part", "--min-gene"], lambda df, a, s: filters.filter_predictions(df, list(filters.PART_TYPES), int(a.min_part), int(a.min_gene))),
    "normalise": ("known genes with one transcript each, with ids by place", [], lambda df, a, s: gff.normalise(df)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandloom", description=__doc__.split("\n", 1)[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, (what, options, _) in FEATURE_COMMANDS.items():
        c = sub.add_parser(name, help=what)
        for o in ("--input", "--output", *options):
            c.add_argument(o, required=True)
    for name, what, options in (
        ("merge", "several feature files as one, ids with the sequence's name before them", ["--input", "--output"]), ("summarize", "summary tables of feature files", ["--input", "--output"]),
        ("evaluate", "predicted features against those of a reference", ["--predicted", "--reference", "--output"]), ("prepare", "training labels of feature files", ["--input", "--sequence", "--output"]),
        ("fasta-blocks", "sequence blocks of FASTA files", ["--input", "--output"]), ("registry", "species and chromosome tables of a YAML registry", ["--input", "--output"]),
    ):
        c = sub.add_parser(name, help=what)
        for o in options:
            c.add_argument(o, required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandloom {a.command}").getOrCreate()
    read = lambda paths: gff.read(spark, files.discover(spark, paths, (".gff", ".gff3", ".gtf")))
    out = getattr(a, "output", None)
    if a.command in FEATURE_COMMANDS:
        x = FEATURE_COMMANDS[a.command][2](read(a.input), a, spark)
        gff.write(x, out, order=["seq", "start", "stop", "type", "strand"] if a.command == "clean" else ["row"])
    elif a.command == "merge":
        gff.write_merged(spark, a.input.split(","), out)
    elif a.command == "summarize":
        for name, table in pipelines.summarize(read(a.input)).items():
            reports.write_table(table, f"{out}/{name}")
    elif a.command == "evaluate":
        reports.write_table(pipelines.evaluate_trees(read(a.predicted), read(a.reference)), out)
    elif a.command == "prepare":
        long = fasta.lengths(fasta.scan(fasta.lines(spark, a.sequence))).select("seq", F.col("length").alias("sequence_length"))
        features = read(a.input).withColumn("canonical", F.try_element_at("attrs", F.lit("canonical"))).join(long, "seq")
        for name, table in pipelines.prepare(features).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}")
    elif a.command == "fasta-blocks":
        fasta.read_blocks(spark, a.input).write.mode("overwrite").parquet(out)
    else:
        for name, table in zip(("species", "chromosomes"), reports.registry_from_yaml(spark, a.input), strict=True):
            table.write.mode("overwrite").parquet(f"{out}/{name}")


if __name__ == "__main__":
    main()
