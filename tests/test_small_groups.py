"""Checks of wide tables and complements of small groups."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import filters, intervals

COLS = "species string, seq string, strand string, gene_id string, gene_start long, gene_stop long, transcript_id string, transcript_start long, transcript_stop long, canonical string, feature_id string, feature_start long, feature_stop long, sequence_length long"


def row(species="s", gene="g", tr="t", part="p", strand="+", flag="1", gs=0, ts=0, fs=0):
    return (species, "c", strand, gene, gs, 100, tr, ts, 100, flag, part, fs, 50, 100)


def test_integrity_sorts_no_species(spark):
    rows = [row(), row(), row(part="q", flag="0"), row(tr="u", strand="-"), row(gene="h", tr="v", gs=-1), row(gene="h", tr="w", ts=2, fs=1), row("z", "k", "x", flag="0"), row("z", "k", "x", "y", flag=None)]
    x = filters.integrity(spark.createDataFrame(rows, COLS))
    assert {r["check"]: r.n_bad for r in x.collect()} == {
        "primary_key_unique": 2, "species_has_canonical": 2, "canonical_consistent": 3, "strand_consistent": 4, "bounds_consistent": 2, "gene_in_sequence": 1, "transcript_in_gene": 0, "feature_in_transcript": 1,
    }
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "+- Window" in line and "gene_id" not in line.split("windowspec")[1] and "transcript_id" not in line.split("windowspec")[1]]


@pytest.mark.parametrize("width", [None, 16])
def test_complement(spark, width):
    draw = random.Random(3)
    domain = [(g, draw.randint(0, 20), draw.randint(21, 60)) for g in range(40)]
    parts = [(g, s, s + draw.randint(0, 12)) for g in range(3, 44) for s in (draw.randint(-20, 80) for _ in range(draw.randint(0, 6)))]
    got = intervals.complement(spark.createDataFrame(parts, "g long, start long, stop long"), spark.createDataFrame(domain, "g long, lo long, hi long"), ("g",), width)
    found = {(r.g, p) for r in got.collect() for p in range(r.start, r.stop)}
    assert found == {(g, p) for g, lo, hi in domain for p in range(lo, hi) if not any(h == g and s <= p < e for h, s, e in parts)}
    assert got.where(F.col("stop") <= F.col("start")).isEmpty()
