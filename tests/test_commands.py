"""Commands over files, and the YAML registry they read."""

import pytest

from strandloom.__main__ import main
from strandloom.sources import fasta, gff, reports

ROWS = [
    ("gene", 1, 100, "ID=g1"), ("mRNA", 1, 100, "ID=m1;Parent=g1"), ("CDS", 1, 30, "ID=c1;Parent=m1"), ("mRNA", 1, 60, "ID=m2;Parent=g1"), ("CDS", 1, 20, "ID=c2;Parent=m2"), ("exon", 1, 100, "ID=x1;Parent=m1"), ("gene", 300, 200, "ID=bad"),
]
YAML = """
species:
  - {id: Sp1, name: Species one, gff: {filename: a.gff, attributes_to_drop: [note]}, fasta: {filename: a.fa}, split: {use_in_training: true, use_in_validation: false, use_in_evaluation: true}, chromosome_map: {NC_1.1: chr1, 2: chr2}}
  - {id: Sp2, name: two, gff: {filename: b.gff}, fasta: {filename: b.fa}, split: {use_in_training: false, use_in_validation: false, use_in_evaluation: false}, chromosome_map: {}}
"""


@pytest.fixture
def features(tmp_path):
    (tmp_path / "a.gff3").write_text("##gff-version 3\n" + "".join(f"NC1\ts\t{k}\t{a}\t{z}\t.\t+\t.\t{at}\n" for k, a, z, at in ROWS))
    return str(tmp_path / "a.gff3")


def ids(spark, path):
    return [r.id for r in gff.read(spark, path).orderBy("row").collect()]


def test_feature_commands(spark, features, tmp_path):
    out = str(tmp_path / "out")
    main(["filter-strand", "--input", features, "--output", out, "--strand", "negative"])
    assert ids(spark, out) == []
    main(["filter-chromosome", "--input", features, "--output", out, "--chromosome", "chr1", "--map", "NC1:chr1, NC2:chr2"])
    assert {r.seq for r in gff.read(spark, out).collect()} == {"chr1"} and len(ids(spark, out)) == 7
    main(["clean", "--input", features, "--output", out])
    assert "bad" not in ids(spark, out) and len(ids(spark, out)) == 6
    main(["representatives", "--input", features, "--output", out, "--mode", "longest"])
    assert ids(spark, out) == ["g1", "m1", "c1", "x1", "bad"]
    main(["remove-exons-utrs", "--input", features, "--output", out])
    assert "x1" not in ids(spark, out)
    main(["set-source", "--input", features, "--output", out, "--source", "mine"])
    assert {r.source for r in gff.read(spark, out).collect()} == {"mine"}
    main(["merge", "--input", f"{features},{tmp_path}/none.gff", "--output", out])
    assert ids(spark, out)[:2] == ["NC1_g1", "NC1_m1"]
    with pytest.raises(SystemExit):
        main(["clean", "--input", features])


def test_tables_of_commands(spark, features, tmp_path):
    main(["summarize", "--input", features, "--output", str(tmp_path / "s")])
    assert {r.type: r.n for r in spark.read.csv(str(tmp_path / "s/by_type"), sep="\t", header=True, inferSchema=True).collect()} == {"gene": 2, "mRNA": 2, "CDS": 2, "exon": 1}
    fasta.write(spark.createDataFrame([("NC1", "ACGT" * 30)], "seq string, dna string"), str(tmp_path / "f"))
    main(["fasta-blocks", "--input", str(tmp_path / "f"), "--output", str(tmp_path / "b")])
    assert [(r.seq, r.dna) for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [("NC1", "ACGT" * 30)]
    main(["evaluate", "--predicted", features, "--reference", features, "--output", str(tmp_path / "e")])
    got = {(r.section, r.level): (r.fp, r.fn) for r in spark.read.csv(str(tmp_path / "e"), sep="\t", header=True, inferSchema=True).collect()}
    assert got["structure", "base"] == (0, 0) and got["locus", "cds_exon"] == (0, 0)


def test_registry_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text(YAML)
    main(["registry", "--input", str(tmp_path / "r.yaml"), "--output", str(tmp_path / "o")])
    r = {x.species: x for x in spark.read.parquet(str(tmp_path / "o/species")).collect()}
    assert r["Sp1"].gff == "a.gff" and r["Sp1"].attributes_to_drop == ["note"] and r["Sp1"].use_in_training and not r["Sp1"].use_in_validation and r["Sp2"].attributes_to_drop is None
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "o/chromosomes")).collect()} == {("Sp1", "NC_1.1", "chr1"), ("Sp1", "2", "chr2")}
    assert [x.species for x in reports.registry_from_yaml(spark, str(tmp_path / "r.yaml"), ["Sp2"])[0].collect()] == ["Sp2"]
    with pytest.raises(ValueError, match="unknown species"):
        reports.registry_from_yaml(spark, str(tmp_path / "r.yaml"), ["Sp3"])
