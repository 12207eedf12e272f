"""Operators that read and deal their rows once."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import evaluate, hierarchy, intervals, labels
from strandloom.operators.sweep import Step, Take, steps
from strandloom.plans import fixtures
from strandloom.sources import gff


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_closed_regions_read_rows_once(spark):
    x = spark.range(60).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.col("id").alias("row"))
    x = x.select(F.col("name").alias("id"), F.when(F.col("row") % 5 > 0, F.concat(F.lit("n"), F.col("row") - F.col("row") % 5)).alias("parent"), "row")
    got = gff.closed_regions(x, 10, width=8)
    assert {(r.row, r.region, r.part) for r in got.collect()} == {(k, k - k % 5, (k - k % 5) // 10) for k in range(60)}
    assert "Range" not in plan(got)


def test_sites(spark):
    """Nested, touching and repeated parts, two transcripts of one place, a null strand on both sides, against a fold over each transcript."""
    draw = random.Random(2)
    cols = "parent string, type string, seq string, strand string, start long, stop long"
    side = lambda: [(f"t{t}", draw.choice(["CDS", "CDS", "exon"]), "c", None if t == 39 else "+-"[t % 2], s, s + draw.randint(1, 9)) for t in range(40) for s in (draw.randint(0, 30) for _ in range(draw.randint(1, 5)))] + [("t39", "CDS", "c", None, 1, 5)]
    both, want = [side(), side()], []
    for rows in both:
        found = set()
        for t in {r[0] for r in rows}:
            own = sorted((r[4], r[5], r[3]) for r in rows if r[0] == t and r[1] == "CDS")
            if own:
                plus, reach = own[0][2] == "+", own[0][1]
                ends = own[0][0], max(z for _, z, _ in own)
                found |= {("tis", own[0][2], ends[not plus]), ("tts", own[0][2], ends[plus])}
                for s, e, _ in own:
                    if s > reach:
                        found |= {("donor", own[0][2], reach if plus else s), ("acceptor", own[0][2], s if plus else reach)}
                    reach = max(reach, e)
        want.append(found)
    p, t = (spark.createDataFrame(rows, cols) for rows in both)
    assert {(r.kind, r.strand, r.pos) for r in evaluate.sites(p).collect()} == want[0]
    got = evaluate.site_counts(p, t)
    hit = {x for x in want[0] & want[1] if x[1]}
    count = lambda k, xs: sum(x[0] == k for x in xs)
    assert {(r.level, r.tp, r.fp, r.fn) for r in got.collect()} == {(k, count(k, hit), count(k, want[0] - hit), count(k, want[1] - hit)) for k in ("tis", "tts", "donor", "acceptor")}
    assert "Join" not in plan(got)


@pytest.mark.parametrize("width", [None, 16])
def test_steps_deal_rows_once(spark, width):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), s, s + draw.randint(0, 9)) for s in (draw.randint(0, 99) for _ in range(60))]
    df = spark.createDataFrame(rows, "seq string, start long, stop long")
    x = steps(df, ("seq",), "start", [Step([F.col("start")], {"a": Take("sum", F.lit(1), here=True)}), Step([F.col("start")], {"b": Take("max", F.col("c"), here=True)}, {"c": F.col("stop") + 1})], width)
    assert x.columns == ["seq", "start", "stop", "a", "c", "b"]
    want = {(q, s): max(z + 1 for p, a, z in rows if p == q and a <= s) for q, s, _ in rows}
    last = {}
    for r in x.collect():
        last[r.seq, r.start] = max(last.get((r.seq, r.start), 0), r.b)
    assert last == want
    merged = {(r.seq, p) for r in intervals.merge(df, ("seq",), width=width).collect() for p in range(r.start, r.stop)}
    assert merged == {(q, p) for q, s, e in rows for p in range(s, e)}


def exchanges(df):
    """Hash shuffles of a query that has run; those that are used again count once."""
    df.collect()
    return sum("- Exchange hashpartitioning" in line for line in plan(df).split("Initial Plan")[0].splitlines())


@pytest.mark.parametrize("width", [None, 16])
def test_gaps_deal_rows_once(spark, width):
    """Gaps of intervals as they are, with nulls, repeats and empty ones, are those of the merged ones, from two shuffles: rows and sums of blocks."""
    draw = random.Random(8)
    some = lambda n: None if draw.random() < 0.1 else n
    rows = [(draw.choice(["a", "b", None]), some(s), some(s + draw.randint(0, 9))) for s in (draw.randint(0, 300) for _ in range(90))]
    df = spark.createDataFrame(rows + rows[:9], "seq string, start long, stop long").repartition(3)
    got = intervals.uncovered(df, ("seq",), width)
    want = intervals.gaps(intervals.merge(df, ("seq",), width=width), ("seq",), width=width)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    x = intervals.uncovered(spark.range(90).selectExpr("id % 3 as seq", "id * 7 as start", "id * 7 + id % 9 as stop"), ("seq",))
    assert exchanges(x) <= 3 < exchanges(intervals.gaps(intervals.merge(df, ("seq",)), ("seq",)))


def test_nothing_ahead_is_made_anew_for_each_row(spark):
    """What lies ahead is a frame from the beginning in reverse order; equal rows are ahead of and before each other the same way."""
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 7, 9), ("a", 8, 9)], "seq string, start long, stop long")
    for width in (None, 16):
        x = intervals.overlap_flag(df, ("seq",), width=width)
        assert [r.has_overlap for r in x.collect()] == [True] * 4
        assert "unboundedfollowing" not in plan(x).lower()


def test_a_gene_and_its_transcripts_are_one_row(spark, monkeypatch):
    """Sets and longest transcripts of random trees are those that interval_sets() and longest_transcript() make, and only genes are written."""
    draw = random.Random(9)
    rows = [(f"g{k}", None, "gene", "c", "+", 0, 99, k) for k in range(8)] + [(f"t{k}", f"g{k // 3}", "mRNA", "c", "+", 0, 99, 100 - k) for k in range(26)]
    for k in range(27):
        for _ in range(0 if k == 4 else draw.randint(1, 5)):
            s = draw.randint(0, 40)
            rows.append((None, f"t{k}", draw.choice(["CDS", "CDS", "five_prime_UTR", "three_prime_UTR", "exon"]), "c", "+", s, s + draw.randint(1, 9), 200))
    df = spark.createDataFrame(rows, "id string, parent string, type string, seq string, strand string, start long, stop long, row long")
    text = lambda r: tuple(str([tuple(v) for v in r[c]]) for c in ("cds", "exon", "intron_cds", "intron"))
    got = sorted((r.id, v.best, *text(v)) for r in evaluate.gene_sets(df).collect() for v in r.sets)
    best = {r.transcript for r in hierarchy.longest_transcript(df).collect()}
    sets = {r.parent: text(r) for r in hierarchy.interval_sets(df).collect()}
    want = sorted((r[1], r[0] in best, *sets[r[0]]) for r in rows if r[2] == "mRNA" and r[0] in sets and r[1] < "g8")
    assert got == want and len(got) > 20
    tables, write = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda x, tag: tables.append(tag) or write(x, tag))
    levels = {r.level: (r.tp, r.fp, r.fn) for r in evaluate.transcript_levels(df, df).collect()}
    assert tables == ["genes", "gene-clusters"] and levels["transcript"] == (8, 0, 0) and levels["intron"][1:] == (0, 0) and levels["intron"][0] > 0


def test_complement_deals_rows_once(spark):
    parts = spark.createDataFrame([("a", 3, 5), ("a", -9, 1), ("a", 4, 8), ("a", 8, 8), ("a", 19, 40), ("a", 60, 70), ("b", 1, 2), ("c", 5, 6), (None, 2, 3), ("f", 2, None)], "seq string, start int, stop int")
    domain = spark.createDataFrame([("a", 0, 20), ("c", 0, 9), ("d", 1, 4), ("e", 4, 4), (None, 0, 3), ("f", 0, 4)], "seq string, lo int, hi int")
    x = intervals.complement(parts, domain, ("seq",), 4)
    assert sorted(map(str, (tuple(r) for r in x.collect()))) == sorted(map(str, [("a", 1, 3), ("a", 8, 19), ("c", 0, 5), ("c", 6, 9), ("d", 1, 4), (None, 0, 2), ("f", 0, 4)]))
    assert exchanges(x) <= 3


def test_region_layers_read_rows_once(spark, tmp_path):
    """Genes, transcripts and parts come from one pass over the lines, without the lengths of sequences that nothing reads."""
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(o, 3 * o + k, 1, k, 9.0, 1.0, "ANR"[(o + k) % 3], "OF"[k % 2], None) for o in range(9) for k in range(1, 5)]
    spark.createDataFrame([*rows, rows[0], (None, 1, 1, 1, 1.0, 1.0, "A", "O", None)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    wide = fixtures.view(spark, str(tmp_path), "wide")
    got = labels.region_layers(wide).where("label not in ('exon', 'intron')")
    seen = wide.collect()
    want = {(r.seq, r.strand, label, a, z) for r in seen for label, a, z in (("gene", r.gene_start, r.gene_stop), ("transcript", r.transcript_start, r.transcript_stop), (r.feature_type, r.feature_start, r.feature_stop))}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    length = {s: max(r.gene_stop for r in seen if r.seq == s) for s in {r.seq for r in seen}}
    assert len(seen) == 37 and all(r.sequence_length == length[r.seq] for r in seen)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def structure_by_hand(rows):
    """Bases, exons, introns, chains and (gene, chain) of one side: rows (id, parent, type, seq, strand, start, stop)."""
    listed = any(r[2] == "exon" for r in rows)
    groups, bases, exons, introns, chains = {}, set(), set(), set(), set()
    for _, parent, kind, seq, strand, s, e in rows:
        if kind == "exon" if listed else kind in ("CDS", "five_prime_UTR", "three_prime_UTR"):
            groups.setdefault((parent, seq, strand), []).append((s, e))
    for (parent, seq, strand), parts in groups.items():
        own = []
        for s, e in sorted(parts):
            if not listed and own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], e))
            else:
                own.append((s, e))
        gaps = {(a[1], b[0]) for a, b in zip(own, own[1:]) if b[0] > a[1]}
        bases |= {(seq, k) for s, e in own for k in range(s, e)}
        exons |= {(seq, strand, *x) for x in own}
        introns |= {(seq, strand, *x) for x in gaps}
        if gaps and parent is not None:
            chains |= {(r[1], (seq, strand, tuple(sorted(gaps)))) for r in rows if r[2] == "mRNA" and r[0] == parent}
    return bases, exons, introns, {c for _, c in chains}, chains


@pytest.mark.parametrize("listed", [(), (0,), (0, 1)])
def test_structure_writes_exons_of_both_sides_once(spark, monkeypatch, listed):
    """Merged and listed exons, repeated mRNA rows, no parent, sequence or strand, transcripts of two strands, against sets by hand."""
    draw = random.Random(6)
    one = [(f"t{k}", None if k == 3 else f"g{k // 2}", "mRNA", "c", "+", 0, 99) for k in range(24) if k != 5] + [("t7", "h", "mRNA", "c", "+", 0, 9), (None, "g0", "mRNA", "c", "+", 0, 9)]
    for k in range(25):
        for _ in range(draw.randint(1, 5)):
            s = draw.randint(0, 60)
            one.append((None, None if k == 24 else f"t{k}", draw.choice(["CDS", "five_prime_UTR", "three_prime_UTR", "other"]), None if k == 9 else "cd"[k % 2], None if k == 10 else draw.choice("+-") if k == 11 else "+", s, s + draw.randint(1, 12)))
    sides = [one, [(*r[:5], r[5], r[6] + (draw.random() < 0.2)) if r[2] != "mRNA" else r for r in one if draw.random() < 0.95]]
    sides = [[(*r[:2], "exon", *r[3:]) if n in listed and r[2] == "CDS" else r for r in rows] for n, rows in enumerate(sides)]
    tables, write = [], evaluate.written
    monkeypatch.setattr(evaluate, "written", lambda df, tag: tables.append(tag) or write(df, tag))
    cols = "id string, parent string, type string, seq string, strand string, start long, stop long"
    got = evaluate.structure_counts(*(spark.createDataFrame(rows, cols) for rows in sides)).collect()
    assert tables == ["exons"]
    p, t = (structure_by_hand(rows) for rows in sides)
    want = {(k, len(p[i] & t[i]), len(p[i] - t[i]), len(t[i] - p[i])) for i, k in enumerate(("base", "exon", "intron", "intron_chain"))}
    loci = lambda x, ok=None: len({g for g, c in x[4] if g is not None and (ok is None or c in ok)})
    hit = loci(p, t[3])
    assert {(r.level, r.tp, r.fp, r.fn) for r in got} == want | {("multi_exon_locus", hit, loci(p) - hit, loci(t) - hit)}
    none = spark.createDataFrame([], cols)
    assert {(r.level, r.tp, r.fp, r.fn, r.f1) for r in evaluate.structure_counts(none, none).collect()} == {(k, 0, 0, 0, 0.0) for k in ("base", "exon", "intron", "intron_chain", "multi_exon_locus")}
