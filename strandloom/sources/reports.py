"""Evaluation reports, tables of results, registries and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import chromosome_number


def comparison_stats(spark: SparkSession, path) -> DataFrame:
    """(path, level, sensitivity, precision) of comparison reports with lines such as `Base level: 85.2 | 90.1 |`."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    p = r"^\s*([A-Za-z ]+?) level:\s*([\d.]+)\s*\|\s*([\d.]+)"
    return x.where(F.col("value").rlike(p)).select("path", F.regexp_replace(F.lower(F.regexp_extract("value", p, 1)), r"\s+", "_").alias("level"), F.regexp_extract("value", p, 2).cast("double").alias("sensitivity"), F.regexp_extract("value", p, 3).cast("double").alias("precision"))


def missed_novel(spark: SparkSession, path) -> DataFrame:
    """(path, kind, feature, n, total) of lines such as `Missed exons: 12/340`."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    p = r"^\s*(Missed|Novel) (\w+):\s*(\d+)/(\d+)"
    return x.where(F.col("value").rlike(p)).select("path", F.lower(F.regexp_extract("value", p, 1)).alias("kind"), F.regexp_extract("value", p, 2).alias("feature"), F.regexp_extract("value", p, 3).cast("long").alias("n"), F.regexp_extract("value", p, 4).cast("long").alias("total"))


def collect_results(spark: SparkSession, tables: dict[str, str], rename: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated result files by tool name, with harmonised columns, sorted by tool, source and level."""
    out = None
    for tool, path in tables.items():
        x = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("tool", F.lit(tool)).withColumn("source", F.col("_metadata.file_name"))
        x = x.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in x.columns})
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.orderBy("tool", "source", *(["level"] if "level" in out.columns else []))


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)  # a report: some dozens of rows


def registry(spark: SparkSession, species: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(species, chromosome_map) tables from a list of {id, name, chromosomes: {source: name}, gff, fasta}: driver-side configuration."""
    rows = [(s["id"], s.get("name"), s.get("gff"), s.get("fasta")) for s in species]
    maps = [(s["id"], a, b) for s in species for a, b in s.get("chromosomes", {}).items()]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("species ids must be unique")
    return spark.createDataFrame(rows, "species string, name string, gff string, fasta string"), spark.createDataFrame(maps, "species string, source string, name string")


def registry_from_yaml(spark: SparkSession, path: str, species: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """registry() tables of a YAML file: a list of species, or one under the key `species`, each with id, name, gff and fasta (filename),
    chromosome_map and split; of equal ids the last entry counts. The species table also has attributes_to_drop and use_in_training,
    use_in_validation and use_in_evaluation. An unknown id in `species` raises."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).toLocalIterator())  # one configuration file
    data = yaml.safe_load(text) or []
    entries = {e["id"]: e for e in (data if isinstance(data, list) else data.get("species", []))}
    if gone := [i for i in species or [] if i not in entries]:
        raise ValueError(f"unknown species {gone}; there are {sorted(entries)}")
    chosen = [entries[i] for i in (species if species is not None else entries)]
    uses = ("use_in_training", "use_in_validation", "use_in_evaluation")
    rows = [(e["id"], e["name"], e["gff"]["filename"], e["fasta"]["filename"], e["gff"].get("attributes_to_drop"), *(bool(e["split"][u]) for u in uses)) for e in chosen]
    maps = [(e["id"], str(a), str(b)) for e in chosen for a, b in e["chromosome_map"].items()]
    ddl = "species string, name string, gff string, fasta string, attributes_to_drop array<string>, " + ", ".join(f"{u} boolean" for u in uses)
    return spark.createDataFrame(rows, ddl), spark.createDataFrame(maps, "species string, source string, name string")


def validate_ids(chromosome_map: DataFrame, features: DataFrame, sequences: DataFrame) -> DataFrame:
    """(species, level, issue, ids) of chromosome_map(species, source, name) against the ids (species, seq) of feature and sequence files.

    Errors: no mapped id in either file (no_features, no_sequence), no name chr<number> (no_numbers). Warnings: mapped ids in one file
    only (features_only, sequence_only), and ids whose order as text is not that of their numbers (order; ids by number)."""
    m = chromosome_map.select("species", "source", chromosome_number(F.col("name")).alias("num"))
    has = lambda d, c: d.select("species", F.col("seq").alias("source"), F.lit(True).alias(c)).distinct()
    x = m.join(has(features, "f"), ["species", "source"], "left").join(has(sequences, "s"), ["species", "source"], "left").fillna(False, ["f", "s"])
    where = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("source"))))  # noqa: E731  the mapped ids of one species
    numbered = F.array_sort(F.collect_set(F.when(F.col("num").isNotNull(), F.struct("num", "source"))))["source"]
    g = x.groupBy("species").agg(F.max("f").alias("f"), F.max("s").alias("s"), where(F.col("f") & ~F.col("s")).alias("fo"), where(F.col("s") & ~F.col("f")).alias("so"), numbered.alias("by_num"))
    none = F.array().cast("array<string>")
    found = [(~F.col("f"), "error", "no_features", none), (~F.col("s"), "error", "no_sequence", none), (F.size("by_num") == 0, "error", "no_numbers", none), (F.size("fo") > 0, "warning", "features_only", F.col("fo")), (F.size("so") > 0, "warning", "sequence_only", F.col("so")), (F.array_sort("by_num") != F.col("by_num"), "warning", "order", F.col("by_num"))]
    rows = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue"), F.array_join(ids, ",").alias("ids"))) for c, level, issue, ids in found)))
    return g.select("species", F.inline(rows))


def write_manifest(entries: list[dict], path: str) -> None:
    """Manifest of a run: one JSON list on the driver's side."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(entries, f, indent=2)


def busco_summary(spark: SparkSession, path) -> DataFrame:
    """(complete, single, duplicated, fragmented, missing, n, path) of BUSCO's short summaries, in percent, a row for each score line
    C:..%[S:..%,D:..%],F:..%,M:..%,n:..; further parts of the line are passed over."""
    number = r"(\d+(?:\.\d+)?)"
    line = rf"C:{number}%\[S:{number}%,D:{number}%\],F:{number}%,M:{number}%.*?,n:(\d+)"
    x = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    return x.select(*(part(k).cast("double").alias(n) for k, n in enumerate(("complete", "single", "duplicated", "fragmented", "missing"), 1)), part(6).cast("long").alias("n"), F.col("_metadata.file_path").alias("path"))


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON, one a line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path, schema: str) -> DataFrame:
    """Rows of JSON lines by a given schema (nothing is inferred, so the files are read once); fields that are not there are null, a line that
    is no JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
