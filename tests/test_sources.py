"""Readers and writers: round trips and malformed input."""

import pytest
from pyspark.sql import functions as F

from strandloom.sources import fasta, gff, reports
from strandloom.streaming import ingest

GFF = """##gff-version 3
##sequence-region chr1 1 5000
chr1\tsrc\tgene\t1000\t2000\t.\t+\t.\tID=g1;Note=a#b "q"
chr1\tsrc\tmRNA\t1000\t2000\t.\t+\t.\tID=m1;Parent=g1
chr1\tsrc\texon\t1000\t1500\t0.5\t+\t.\tID=e1;Parent=m1
# a comment
chr2\tsrc\texon\t1600\t2000\t.\t-\t2\tID=e2;Parent=m1
"""


def test_gff_round_trip(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    df = gff.read(spark, str(tmp_path / "a.gff3"))
    got = df.orderBy("row").collect()
    assert [(r.start, r.stop, r.phase, r.score) for r in got] == [(999, 2000, None, None), (999, 2000, None, None), (999, 1500, None, 0.5), (1599, 2000, 2, None)]
    assert got[0].attrs["Note"] == 'a#b "q"' and got[2].parent == "m1"
    gff.write(df, str(tmp_path / "out"), ["##gff-version 3"])
    again = gff.read(spark, str(tmp_path / "out"))
    assert [r.asDict() | {"row": 0} for r in again.orderBy("row").collect()] == [r.asDict() | {"row": 0} for r in got]
    assert gff.header(spark, str(tmp_path / "a.gff3")).count() == 3
    d = {r.name: r["values"] for r in gff.directives(spark, str(tmp_path / "a.gff3")).collect()}
    assert d["sequence-region"] == ["chr1", "0", "5000"]
    assert gff.read(spark, str(tmp_path / "a.gff3"), types=["exon"], seqs=["chr2"]).count() == 1
    counts, kinds = gff.profile(df)
    assert {(r.parent_type, r.child_type, r["count"]) for r in kinds.collect()} == {("gene", "mRNA", 1), ("mRNA", "exon", 2)}
    wide = gff.promote(df)
    assert {"id", "parent", "note"} <= set(wide.columns)


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('c\ts\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t; 1"; n 3;\n')
    r = gff.read_gtf(spark, str(tmp_path / "a.gtf")).first()
    assert r.parent.startswith("t") and r.attrs["gene_id"] == "g" and r.attrs["n"] == "3" and r.start == 0


def test_embedded_fasta(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF + "##FASTA\n>chr1 title\nACGT\nAC\n>chr2\nGG\n")
    assert {(r.seq, r.dna) for r in gff.embedded_fasta(spark, str(tmp_path / "a.gff3")).collect()} == {("chr1", "ACGTAC"), ("chr2", "GG")}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGTAC\nGT\n>c2\n\nTTT\n")
    df = fasta.read(spark, str(tmp_path / "a.fa"))
    assert {(r.seq, r.dna) for r in df.collect()} == {("c1", "ACGTACGT"), ("c2", "TTT")}
    assert {(r.seq, r.offset, r.dna) for r in fasta.blocks(df, 3).collect()} == {("c1", 0, "ACG"), ("c1", 3, "TAC"), ("c1", 6, "GT"), ("c2", 0, "TTT")}
    assert [r.seq for r in fasta.longest(df, 1).collect()] == ["c1"]
    fasta.write(df.select("seq", "dna"), str(tmp_path / "o"), 5)
    assert {(r.seq, r.dna) for r in fasta.read(spark, str(tmp_path / "o")).select("seq", "dna").collect()} == {("c1", "ACGTACGT"), ("c2", "TTT")}
    assert [r.seq for r in fasta.read(spark, str(tmp_path / "a.fa"), {"c2": "two"}).collect()] == ["two"]


def test_fasta_scan_over_splits(spark, tmp_path, monkeypatch):
    """Records that cross many splits, titles with > inside, empty records and several files: the same as a plain parse of each file."""
    import random

    rng = random.Random(5)
    want, lengths = {}, {}
    for name in ("a", "b"):
        out = ["\n", "lost text before the first title\n"]
        for k in range(12):
            dna = "".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([0, 1, 59, 60, 61, 900, 2500])))
            out.append(f">{name}{k} mutation A->B >x\n" + "".join(dna[i : i + 60] + "\n" for i in range(0, len(dna), 60)) + rng.choice(["", "\n"]))
            want[name, f"{name}{k}"] = dna
        (tmp_path / f"{name}.fa").write_text("".join(out))
    monkeypatch.setattr(fasta, "PIECE", 256)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        scanned = fasta.scan(fasta.lines(spark, str(tmp_path / "*.fa")))
        assert fasta.lines(spark, str(tmp_path / "a.fa")).select("split").distinct().count() > 10
        assert scanned.agg(F.max(F.length("dna"))).first()[0] <= 256
        file = lambda r: r.path.rsplit("/", 1)[1][0]
        assert {(file(r), r.seq): r.dna for r in fasta.whole(scanned).collect()} == want
        assert {(file(r), r.seq): r.length for r in fasta.lengths(scanned).collect()} == {k: len(v) for k, v in want.items()}
        got = {(file(r), r.seq, r.block): (r.offset, r.dna) for r in fasta.read_blocks(spark, str(tmp_path / "*.fa"), 100, 7).collect()}
        assert got == {(f, s, b): (b * 100, d[b * 100 : b * 100 + 107]) for (f, s), d in want.items() for b in range(-(-len(d) // 100))}
        assert [r.seq for r in fasta.read_blocks(spark, str(tmp_path / "a.fa"), 4000, names={"a3": "three"}).collect()] in (["three"], [])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    (tmp_path / "none.fa").write_text("")
    assert fasta.read(spark, str(tmp_path / "none.fa")).collect() == []


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    line = "chr1\ts\texon\t{}\t{}\t.\t+\t.\tID=e{}\n"
    (tmp_path / "a.gff").write_text("##gff-version 3\n" + line.format(1, 2, 0))
    (tmp_path / "b.gff").write_text("".join(line.format(i, i + 1, i) + "# note\n" * (i % 3) for i in range(1, 51)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("200", keep):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = gff.read(spark, [str(tmp_path / "b.gff"), str(tmp_path / "a.gff")], types=["exon"]).orderBy("row").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        assert [(r.row, r.id) for r in got] == [(i, f"e{i}") for i in range(51)]


def test_embedded_fasta_over_splits(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF * 20 + "##FASTA\n>chr1 A->B\ttab\n" + "ACGTACGTAC\n" * 50 + "\n>chr2\nGG\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert {(r.seq, r.dna) for r in gff.embedded_fasta(spark, str(tmp_path / "a.gff3")).collect()} == {("chr1", "ACGTACGTAC" * 50), ("chr2", "GG")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_reports(spark, tmp_path):
    (tmp_path / "s").write_text("#  x\n        Base level:    85.2     |    90.1    |\n Intron chain level: 1.5 | 2.5 |\n  Missed exons:      12/340 ( 3.5%)\n")
    assert {(r.level, r.sensitivity, r.precision) for r in reports.comparison_stats(spark, str(tmp_path / "s")).collect()} == {("base", 85.2, 90.1), ("intron_chain", 1.5, 2.5)}
    r = reports.missed_novel(spark, str(tmp_path / "s")).first()
    assert (r.kind, r.feature, r.n, r.total) == ("missed", "exons", 12, 340)
    sp, cm = reports.registry(spark, [{"id": "Ath", "name": "A", "chromosomes": {"1": "chr1", "2": "chr2"}}])
    assert sp.count() == 1 and cm.count() == 2


def test_ingest_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.gff3").write_text(GFF)
    go = lambda: ingest.ingest_features(spark, str(src), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    go()
    (src / "b.gff3").write_text(GFF.replace("chr1", "chr9"))
    go()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:01:10", "a", 4.0)], "ts string, event_type string, value double")
    got = ingest.windowed_counts(df, "1 minute", "5 minutes").select(F.col("window.start").cast("string").alias("s"), "n", "total").orderBy("s").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 4.0)]


def test_discover(spark, tmp_path):
    from strandloom.sources import files

    for name in ("a.gff", "b.gff.gz", "c.txt", "sub/d.gff", "sub/_x.gff"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    names = lambda *x: [p.rsplit("/", 1)[1] for p in files.discover(spark, ",".join(f"{tmp_path}/{i}" for i in x), (".gff",))]
    assert names("") == ["a.gff", "b.gff.gz", "d.gff"] and names("a.gff", "sub", "a.gff") == ["a.gff", "d.gff"]
    assert names("b.gff") == ["b.gff.gz"] and names("a.gff.gz") == ["a.gff"] and names("*") == ["a.gff", "b.gff.gz", "d.gff"] and names("c.txt") == ["c.txt"]
    with pytest.raises(FileNotFoundError):
        names("none.gff")


def test_normalise(spark, tmp_path):
    lines = ["gene\t1\t100\tID=g1", "transcript\t1\t90\tID=t1;Parent=g1;tag=basic", "mRNA\t1\t50\tID=t2;Parent=g1;tag=basic,Ensembl_canonical", "exon\t1\t50\tID=e;Parent=t1,t2", "CDS\t1\t20\tID=c;Parent=t2", "CDS\t30\t40\tID=c;Parent=t2",
             "CDS\t30\t40\tID=d;Parent=t1", "gene\t200\t300\tID=g2", "mRNA\t1\t9\tID=t9;Parent=gone", "gene\t400\t500\tID=g3", "transcript\t400\t450\tID=t4;Parent=g3", "transcript\t440\t500\tID=t5;Parent=g3"]
    text = "".join("\t".join(("c", "s", k, a, b, ".", "+", ".", at)) + "\n" for k, a, b, at in (x.split("\t") for x in lines))
    (tmp_path / "a.gff3").write_text(text)
    got = gff.normalise(gff.read(spark, str(tmp_path / "a.gff3")))
    assert {(r.type, r.id, r.parent, r.attrs.get("longest")) for r in got.collect()} == {
        ("gene", "g1", None, None), ("mRNA", "t2", "g1", "1"), ("exon", "exon:t2:1:50:+", "t2", None), ("CDS", "CDS:t2:1:20:+", "t2", None), ("CDS", "CDS:t2:30:40:+", "t2", None), ("gene", "g3", None, None), ("mRNA", "t5", "g3", "1"),
    }
    assert "Parent=t2" in got.where("type = 'exon'").first().attributes
    (tmp_path / "b.gff3").write_text(text + text.split("\n")[0] + "\n")
    with pytest.raises(Exception, match="several rows of g1"):
        gff.normalise(gff.read(spark, str(tmp_path / "b.gff3"))).collect()


def test_strict_write_scan_filters_and_repeated_keys(spark, tmp_path):
    (tmp_path / "a.gff3").write_text(GFF)
    df = gff.read(spark, str(tmp_path / "a.gff3"), source_types=[("src", "exon"), ("other", "gene")])
    assert [r.id for r in df.orderBy("row").collect()] == ["e1", "e2"]
    with pytest.raises(Exception, match="null in a required column"):
        gff.write(df, str(tmp_path / "o"), fill_missing=False)
    with pytest.raises(ValueError):
        gff.write(df.drop("score"), str(tmp_path / "o"), fill_missing=False)
    gff.write(df.withColumn("score", F.lit(1.0)).withColumn("phase", F.lit(0)), str(tmp_path / "p"), fill_missing=False)
    assert gff.read(spark, str(tmp_path / "p")).count() == 2
    (tmp_path / "a.gtf").write_text('c\ts\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t"; tag "a"; tag "b";\n')
    assert gff.read_gtf(spark, str(tmp_path / "a.gtf")).first().attrs["tag"] == "a,b"


def test_validate_ids(spark):
    m = spark.createDataFrame([("s", "b", "chr1"), ("s", "a", "chr2"), ("s", "u", "scaffold"), ("t", "x", "one")], "species string, source string, name string")
    f = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "zz"), ("t", "x")], "species string, seq string")
    q = spark.createDataFrame([("s", "b"), ("s", "u")], "species string, seq string")
    assert {tuple(r) for r in reports.validate_ids(m, f, q).collect()} == {
        ("s", "warning", "features_only", "a"), ("s", "warning", "sequence_only", "u"), ("s", "warning", "order", "b,a"), ("t", "error", "no_sequence", ""), ("t", "warning", "features_only", "x"), ("t", "error", "no_numbers", ""),
    }


def test_parts_hold_whole_trees(spark, tmp_path):
    """Late and early children, several parents, names that are never defined, and rows without names: as the whole parse, part by part."""
    import random

    rng = random.Random(3)
    lines, clock = [], 0
    for g in range(40):
        tree = [("gene", f"g{g}", None), ("mRNA", f"m{g}a", f"g{g}"), ("mRNA", f"m{g}b", f"g{g}"), ("exon", f"e{g}", f"m{g}a,m{g}b"), ("CDS", None, f"m{g}a"), ("CDS", None, f"gone{g}"), ("region", None, None)]
        rng.shuffle(tree)
        for k, (kind, name, parent) in enumerate(tree):
            lines.append((clock + k + rng.choice([0, 0, 9]), kind, ";".join(x for x in (name and f"ID={name}", parent and f"Parent={parent}") if x) or "."))
        clock += rng.choice([7, 7, 30])
    lines.sort(key=lambda x: x[0])
    (tmp_path / "a.gff3").write_text("".join(f"c\ts\t{k}\t{i + 1}\t{i + 5}\t.\t+\t.\t{a}\n" for i, (_, k, a) in enumerate(lines)))
    whole = gff.read(spark, str(tmp_path / "a.gff3"))
    got = {r.row: (r.region, r.part) for r in gff.closed_regions(whole, 20, width=8).collect()}
    rows = sorted(whole.collect(), key=lambda r: r.row)
    span = {}
    for r in rows:
        for n in [r.id, *(r.parent or "").split(",")]:
            if n:
                span[n] = (span.get(n, (r.row,))[0], r.row)
    open_to, begin = -1, 0
    for r in rows:
        begin = r.row if open_to < r.row else begin
        open_to = max([open_to, *(b for a, b in span.values() if a == r.row)])
        assert got[r.row] == (begin, begin // 20)
    assert len({x for x, _ in got.values()}) > 10
    parts = [p.collect() for p in gff.parse_in_parts(spark, str(tmp_path / "a.gff3"), 20)]
    assert len(parts) > 3 and sorted(r.row for p in parts for r in p) == [r.row for r in rows]
    assert [min(r.row for r in p) for p in parts] == sorted(min(r.row for r in p) for p in parts)
    known = {r.id for r in rows if r.id}
    for p in parts:
        ids = {r.id for r in p}
        assert all(x in ids for r in p for x in (r.parent or "").split(",") if x in known)


def test_quoted_attributes(spark):
    from strandloom.functions import attributes as A

    cases = {
        'ID=a;Note="x; y, z";Alias=p,q%20r;flag;k=': {"ID": ["a"], "Note": ["x; y, z"], "Alias": ["p", "q r"], "flag": ["true"], "k": ["true"]},
        'gene_id "g"; transcript_id "t; 1"; n 3; tag "a"; tag "b";': {"gene_id": ["g"], "transcript_id": ["t; 1"], "n": ["3"], "tag": ["a", "b"]},
        'Sequence "Y74C9A" ; Note "Clone Y74C9A; Genbank AC024206"': {"Sequence": ["Y74C9A"], "Note": ["Clone Y74C9A; Genbank AC024206"]},
        'name "fgenesh1_pg.C_chr_1000003"; transcriptId 869': {"name": ["fgenesh1_pg.C_chr_1000003"], "transcriptId": ["869"]},
        "count=9;gene=amx-2;sequence=SAGE:aacggagccg": {"count": ["9"], "gene": ["amx-2"], "sequence": ["SAGE:aacggagccg"]},
        "ID=a=b;Note=100%;x=a+b%2C;x=c": {"ID": ["a=b"], "Note": ["100%"], "x": ["a+b,", "c"]},
        'Note=lone" quote;b=1': {"Note": ['lone" quote'], "b": ["1"]},
        " ;; ;": {}, "": {}, None: {}, 'Note="";a=,': {"Note": ["true"], "a": ["true"]},
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, a string")
    got = {r.a: r.m for r in df.select("a", A.parse_quoted(F.col("a")).alias("m")).collect()}
    assert got == cases


def test_records(spark, tmp_path):
    lines = [
        ("##sequence-region c 1 9", ("directive", "sequence-region c 1 9", None, None)), ("# note", None), ("", None), ("###", ("directive", "#", None, None)),
        ("c\ts\tgene\t1\t9\t.\t+\t.\tID=g", ("parent", None, "g", None)), ("c\ts\tmRNA\t1\t9\t.\t+\t.\tID=m;Parent=g,h", ("child", None, "m", ["g", "h"])),
        ("c\ts\texon\t1\t9\t.\t?\t.\tID=x;Parent=x", ("child", None, None, ["x"])), ("c\ts\tregion\t1\t9\t.\t.\t.", ("feature", None, None, None)),
        ("c\ts\tgene\t.\t.\t.\t.\t.\tID=a", ("annotation", None, "a", None)),
        ('c\ts\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t; 1"', ("child", None, None, ["t; 1"])), ("c\ts\tCDS\t1\t9\t.\t+\t0\tname x; proteinId 7", ("child", None, None, ["7"])),
        ('c\ts\tTranscript\t1\t9\t.\t+\t.\tTranscript "B1" ; Note "q; r"', ("parent", None, "B1", None)), ('c\ts\tcoding_exon\t1\t9\t.\t+\t.\tTranscript "B1"', ("child", None, None, ["B1"])),
        ('c\ts\tCDS\t1\t9\t.\t+\t.\tCDS "C1"', ("parent", None, "C1", None)), ('c\ts\tCDS\t1\t9\t.\t+\t.\tTranscript "B1" ; CDS "C1"', ("child", None, None, ["B1"])), ('c\ts\tother\t1\t9\t.\t+\t.\tTranscript "B1"', ("feature", None, None, None)),
    ]
    (tmp_path / "a.gff").write_text("".join(x + "\n" for x, _ in lines))
    got = gff.records(spark, str(tmp_path / "a.gff")).orderBy("row").collect()
    assert [(r.kind, r.text, r.id, r.parents) for r in got] == [w for _, w in lines if w]
    assert got[5].strand is None or got[5].strand == "+"
    (tmp_path / "b.gff").write_text("c\ts\tgene\n")
    with pytest.raises(Exception, match="under eight fields"):
        gff.records(spark, str(tmp_path / "b.gff")).collect()


def test_merge_lines_and_busco(spark, tmp_path):
    feature = "c$1\ts\tgene\t1\t9\t.\t+\t.\t"
    (tmp_path / "a.gff").write_text(f"##gff-version 3\n# own\n{feature}ID=g;x=1\n\nshort\tline\n{feature}Parent=p,q;ID=h\n{feature}.\n")
    (tmp_path / "b.gff").write_text(f"##gff-version 3\n{feature.replace('c$1', 'd')}ID=g;geneID=7\n")
    paths = [str(tmp_path / n) for n in ("none.gff", "a.gff", "gone.gff", "b.gff")]
    gff.write_merged(spark, paths, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    want = ["##gff-version 3", "# own", f"{feature}ID=c$1_g;x=1", "short\tline", f"{feature}Parent=c$1_p,c$1_q;ID=c$1_h", f"{feature}.", f"{feature.replace('c$1', 'd')}ID=d_g;geneID=7"]
    assert "".join(p.read_text() for p in parts).splitlines() == want
    with pytest.raises(FileNotFoundError):
        gff.merge_lines(spark, paths[:1])
    (tmp_path / "short_summary.txt").write_text("# BUSCO\n\tC:99.1%[S:97.0%,D:2.1%],F:0.5%,M:0.4%,n:2326\t\n\t2305\tComplete BUSCOs (C)\n")
    r = reports.busco_summary(spark, str(tmp_path / "short_summary.txt")).collect()
    assert [tuple(x)[:6] for x in r] == [(99.1, 97.0, 2.1, 0.5, 0.4, 2326)]


def test_summaries_and_groups(spark, tmp_path):
    from strandloom.operators import dataset, stats

    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.5), (None, 3, 0.1)], "k string, n long, v double")
    reports.write_summary(df, str(tmp_path / "s"))
    assert {tuple(r) for r in reports.read_summary(spark, str(tmp_path / "s"), "k string, n long, v double, more int").collect()} == {("a", 1, None, None), ("b", None, 2.5, None), (None, 3, 0.1, None)}
    (tmp_path / "bad.json").write_text("{no json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        reports.read_summary(spark, str(tmp_path / "bad.json"), "k string").collect()
    other = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert {tuple(r) for r in dataset.group_presence(df, other, ["k"]).collect()} == {("a", True, True), ("b", True, False), ("z", False, True), (None, True, True)}
    assert {r.k for r in dataset.common_groups(df, other, ["k"]).collect()} == {"a", None}
    assert {tuple(r) for r in stats.mask_rate(df.unionByName(df), F.col("v") > 1, "k").collect()} == {("a", 2, 0, 0.0), ("b", 2, 2, 1.0), (None, 2, 0, 0.0)}
    assert [r.k for r in stats.value_counts(other.unionByName(other.limit(1)), "k").collect()] == ["a", None, "z"]
