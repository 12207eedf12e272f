"""Genes with their bases: one row a gene travels to the blocks of a sequence."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.operators import orf
from strandloom.sources import fasta

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def test_gene_table_moves_one_row_a_gene(spark, monkeypatch):
    draw = random.Random(5)
    size = fasta.SLICE
    dna = {"a": "".join(draw.choices("ACGT", k=2 * size + 50)), "b": "ACGT" * 10, "e": ""}
    genes = [("a", "+", "g0", 10, 400), ("a", "-", "g1", size - 20, size + 90), ("b", "-", "g2", 4, 30), ("b", "+", "g3", 38, 60), ("b", "+", "g4", 90, 99), ("e", "+", "g5", 0, 9), ("no", "+", "g6", 0, 9), ("a", "-", "g7", 5, 50)]
    cds = {"g0": [(10, 20), (300, 400), (10, 20)], "g1": [(size - 20, size - 5), (size - 3, size + 4), (size + 80, size + 90)], "g2": [(4, 9), (20, 30)], "g3": [(38, 60)], "g4": [(90, 99)], "g5": [(0, 9)], "g6": [(0, 9)]}
    tree = [(s, st, a, z, g, None, "gene") for s, st, g, a, z in genes]
    tree += [(s, st, a, z, f"{g}.{t}", g, "mRNA") for s, st, g, a, z in genes for t in "xy"]
    tree += [(s, st, a, z, None, f"{g}.{'xy'[k % 2]}", "CDS") for s, st, g, _, _ in genes for k, (a, z) in enumerate(cds.get(g, []))]
    moved, write = [], fasta.written
    monkeypatch.setattr(fasta, "written", lambda df, tag: moved.append(write(df, tag)) or moved[-1])
    x = orf.gene_table(spark.createDataFrame(tree, "seq string, strand string, start long, stop long, id string, parent string, type string"), spark.createDataFrame(list(dna.items()), "seq string, dna string"))

    def read(seq, strand, places):
        s = "".join(dna[seq][max(a, 0) : max(z, 0)] for a, z in sorted(set(places)))
        return s.translate(COMPLEMENT)[::-1] if strand == "-" else s

    want = set()
    for s, st, g, a, z in genes:
        if s in dna:
            d, r = (z - 1, a - 2) if st == "+" else (z - 2, a + 1)
            want.add((g, read(s, st, cds.get(g, [])), read(s, st, [(max(d, 0), max(d, 0) + 2)]), read(s, st, [(max(r, 0), max(r, 0) + 2)])))
    got = [(r.gene, r.cds, r.donor, r.acceptor) for r in x.collect()]
    assert len(got) == len(want) and set(got) == want
    assert moved[0].count() == len(genes) + 1  # g1 lies in two blocks


def test_bases_of_blocks_with_other_letters(spark):
    """Pieces are cut by bytes where a block is ASCII and by letters where it is not."""
    size = 8
    dna = {"a": "ACGTACGTAé" + "ACGTAC" + "ACGTTGCA", "b": "ACGTTGCAAC"}
    places = [(s, k, z) for s, text in dna.items() for k in range(len(text)) for z in (k + 1, k + 5, k + 11)]
    one = lambda a, z: F.array(F.struct(F.lit("x").alias("kind"), F.col(a).alias("start"), F.col(z).alias("stop")))
    rows = spark.createDataFrame(places, "seq string, k long, z long").select("seq", "k", "z", one("k", "z").alias("places"))
    got = fasta.cut_lists(rows, spark.createDataFrame(list(dna.items()), "seq string, dna string"), size)
    found = {(r.seq, r.k, r.z): "".join(v.dna for v in sorted(r.found, key=lambda v: v.block)) for r in got.collect()}
    assert found == {(s, k, z): dna[s][k:z] for s, k, z in places}


def test_only_genes_that_begin_with_a_start_codon_are_tried(monkeypatch):
    draw = random.Random(7)
    cds = ["".join(draw.choices("ACGT", k=6)) for _ in range(400)] + ["ATGGCC", "GCATAA", "ATGTAA", "AT", "GTAA", "", None]
    n = len(cds)
    t = pa.table({"seq": ["s"] * 200 + ["t"] * (n - 200), "strand": ["+"] * n, "part": [0] * n, "idx": list(range(200)) + list(range(n - 200)), "beyond": [0] * n, "gene": [f"g{k}" for k in range(n)], "start": [9 * k for k in range(n)], "stop": [9 * k + 6 for k in range(n)], "cds": pa.array(cds), "donor": ["AA"] * n, "acceptor": ["AA"] * n})
    tried, chain = [], orf._chain
    every = lambda lo, hi: [(lo + k, chain([orf.Gene(*(t[c][i].as_py() for c in orf.Gene._fields)) for i in range(lo, hi)], k, [bool(c) and orf.complete(c) for c in cds[lo:hi]])) for k in range(hi - lo)]
    want = [(f"g{k}", made[1]) for k, made in every(0, 200) + every(200, n) if isinstance(made, tuple)]
    monkeypatch.setattr(orf, "_chain", lambda rows, i, whole: tried.append(i) or chain(rows, i, whole))
    edges = orf._edges(t, ("seq", "strand", "part"))
    assert edges.tolist() == [0, 200]
    got = [(r[2][0], r[4]) for r in orf._decided(t, edges, 1024, False) if r[2]]
    assert got == want and ("g400", "ATGGCCGCATAA") in got and len(tried) == sum(c is not None and (c.startswith("ATG") or len(c) < 3) for c in cds) < 30
    assert np.array_equal(orf._edges(t.slice(0, 0), ("seq",)), [])
