"""Whole workflows as one lazily planned program each: prediction, training-data preparation, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logits as L
from ..operators import decode, evaluate, filters, hierarchy, labels, orf, runs, stats, trees
from ..operators.tables import written
from ..sources import fasta

#: Class groups of decoded states, by name of the interval that they make.
ENTITIES = {"transcript": [1, 2, 3, 4], "exon": [2, 3, 4], "intron": [1], "five_prime_UTR": [2], "CDS": [3], "three_prime_UTR": [4]}


def score(windows: DataFrame, scorer: Callable[[list[str]], np.ndarray], states: int = 5) -> DataFrame:
    """(seq, strand, pos, logits) of each window's valid part. scorer gets a batch of window strings and returns [window, base, state].

    windows: seq, strand, start, stop, v_start, v_stop, dna. Valid parts tile a sequence, so every base gets one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            found = scorer(cols["dna"])
            for i in range(b.num_rows):
                a, z, s = cols["v_start"][i], cols["v_stop"][i], cols["start"][i]
                part = np.asarray(found[i], np.float64)[a - s : z - s]
                flat = pa.array(part.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * states + 1, states), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([cols["seq"][i]] * len(part)), pa.array([cols["strand"][i]] * len(part)), pa.array(np.arange(a, z)), lists], names=["seq", "strand", "pos", "logits"])

    cols = ["seq", "strand", "start", "stop", "v_start", "v_stop", "dna"]
    return windows.select(*cols).mapInArrow(run, "seq string, strand string, pos long, logits array<double>")


def sequence_windows(sequence: DataFrame, window: int, stride: int) -> DataFrame:
    """Windows of both strands of sequence(seq, dna); the negative strand is the complement in genomic order."""
    from ..functions.dna import complement

    x = sequence.select("seq", F.length("dna").alias("n")).withColumn("length", runs.padded_length(F.col("n"), window, stride))
    w = runs.index_windows(x, "length", window, stride).withColumn("v_stop", F.least("v_stop", "n")).where("v_start < v_stop")
    key = ("name", "v_start", "v_stop", "w_start", "w_stop")
    w = fasta.cut(w.select("seq", "start", "stop", F.col("seq").alias("name"), "v_start", "v_stop", F.col("start").alias("w_start"), F.col("stop").alias("w_stop")), fasta.blocks(sequence, fasta.SLICE), key)
    w = w.withColumn("dna", F.rpad("dna", window, "N")).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    dna = F.when(F.col("strand") == "-", complement(F.col("dna"))).otherwise(F.col("dna")).alias("dna")
    return w.select(F.col("name").alias("seq"), "strand", F.col("w_start").alias("start"), F.col("w_stop").alias("stop"), "v_start", "v_stop", dna)


def predicted_intervals(scored: DataFrame, bias: float = 0.0, domain: str = "plant", complete: bool = True, direct: bool = False, alpha: float | None = None) -> DataFrame:
    """(seq, strand, entity, start, stop) from scored positions (seq, strand, pos, logits): bias, softmax, decoding in reading order, runs.

    The negative strand is decoded from its end."""
    last = scored.groupBy("seq", "strand").agg(F.max("pos").alias("last"))
    x = scored.join(last, ["seq", "strand"]).withColumn("probs", L.softmax(L.biased(F.col("logits"), bias)))
    x = x.withColumn("at", F.when(F.col("strand") == "-", F.col("last") - F.col("pos")).otherwise(F.col("pos")))
    if direct:
        path = x.select("seq", "strand", "pos", decode.direct_path(F.col("probs")).alias("state"))
    else:
        made = decode.viterbi_paths(x.select("seq", "strand", F.col("at").alias("pos"), "probs"), ["seq", "strand"], decode.priors(domain, complete), alpha=alpha)
        path = made.join(last, ["seq", "strand"]).withColumn("pos", F.when(F.col("strand") == "-", F.col("last") - F.col("pos")).otherwise(F.col("pos"))).drop("last")
    return runs.group_runs(runs.runs(path, ["seq", "strand"], "state"), ["seq", "strand"], ENTITIES, "state")


def predict(sequence: DataFrame, scorer: Callable[[list[str]], np.ndarray], window: int = 8192, stride: int = 4096, min_length: int = 3, min_part: int = 3, min_gene: int = 30, **decoding) -> DataFrame:
    """Feature rows from sequence(seq, dna): windows, scores, decoding, grouping, emission and the usual filters.

    Scores and intervals are written once to the shared folder, as later steps read them several times."""
    scored = written(score(sequence_windows(sequence, window, stride), scorer), "scores")
    found = written(predicted_intervals(scored, **decoding), "predicted")
    tree = hierarchy.emit_features(hierarchy.group_parts(found, min_length))
    return filters.filter_predictions(tree, list(filters.PART_TYPES), min_part, min_gene)


def prepare(features: DataFrame, up: int = 944, down: int = 1240) -> dict[str, DataFrame]:
    """Training labels from a feature tree: kept wide rows, the filter log, feature and region layers and masks, as run-length intervals."""
    wide = written(hierarchy.flatten(features), "wide")
    kept, log = filters.filter_features(wide)
    domain = wide.groupBy("seq", "strand").agg(F.lit(0).cast("long").alias("lo"), F.max("sequence_length").alias("hi"))
    genes = wide.select("seq", "strand", "gene_id", F.col("gene_start").alias("start"), F.col("gene_stop").alias("stop")).distinct()
    kept, log = written(kept, "kept"), written(log, "log")
    masks = labels.reason_masks(log.select("seq", "strand", "gene_id", "reason", "start", "stop"), genes, domain, up=up, down=down)
    return {"kept": kept, "log": log, "stacked": hierarchy.stack(kept), "layers": labels.feature_layers(kept, domain), "regions": labels.region_layers(kept), "masks": masks}


def summarize(features: DataFrame) -> dict[str, DataFrame]:
    """Summary tables of a feature tree: counts with percentages, transcripts per gene, canonical rate and kinds of parts."""
    tables = {f"by_{c}": stats.value_counts(features, c) for c in ("source", "type", "strand", "seq") if c in features.columns}
    tables |= {"transcripts_per_gene": stats.children_histogram(features), "type_combinations": stats.type_combinations(features)}
    if "canonical" in features.columns:
        tables["canonical_rate"] = stats.canonical_rate(features)
    return tables


def evaluate_trees(pred: DataFrame, true: DataFrame) -> DataFrame:
    """One table (section, level, tp, fp, fn, precision, recall, f1) of all evaluation levels."""
    parts = {"locus": evaluate.locus_counts, "structure": evaluate.structure_counts, "pairs": evaluate.transcript_levels, "sites": evaluate.site_counts}
    out = None
    for name, f in parts.items():
        x = f(pred, true).withColumn("section", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.select("section", "level", "tp", "fp", "fn", "precision", "recall", "f1")


def transcript_fasta(features: DataFrame, sequence: DataFrame, path: str) -> None:
    fasta.write(fasta.transcripts(features, sequence, ("CDS", "five_prime_UTR", "three_prime_UTR")), path)


def join_fragments(features: DataFrame, sequence: DataFrame, embedder: Callable[[list[str]], list[np.ndarray]], models: dict[str, trees.Ensemble], threshold: float = 0.5, keep_unmerged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(feature tree with accepted chains joined, scores by key): candidate proteins of genes and of chains of fragments are embedded,
    scored by all models, and chains with a mean of at least the threshold are joined."""
    found = written(orf.candidates(orf.gene_table(features, sequence)), "candidates")
    proteins = trees.embed(found.select("key", "protein").distinct(), embedder, "protein")
    scores = written(trees.score(proteins, models, "key", "features", threshold), "protein-scores")
    merges = found.where(F.size("members") > 1).join(scores.where("predicted_label = 1").select("key"), "key", "left_semi").select("members")
    return orf.apply_merges(features, merges, keep_unmerged), scores
