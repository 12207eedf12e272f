"""Single operators on literal inputs, after the cases that the blueprint lists."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import attributes as A
from strandloom.functions import dna as D
from strandloom.operators import decode, evaluate, filters, hierarchy, intervals, orf, runs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


IV = "seq string, strand string, start long, stop long"


@pytest.mark.parametrize("starts, stops, flags", [
    ([1, 3, 7, 15], [5, 6, 12, 20], [True, True, False, False]),
    ([0, 5], [5, 9], [False, False]),
    ([0, 2, 20], [10, 4, 30], [True, True, False]),
    ([0, 1, 2], [10, 3, 9], [True, True, True]),
])
def test_overlap_flag(spark, starts, stops, flags):
    df = frame(spark, [("c", "+", a, b) for a, b in zip(starts, stops)], IV)
    assert [r.has_overlap for r in intervals.overlap_flag(df).orderBy("start").collect()] == flags


def test_merge_nested_touching_and_gaps(spark):
    df = frame(spark, [("c", "+", 0, 10), ("c", "+", 2, 4), ("c", "+", 10, 12), ("c", "+", 20, 25), ("d", "-", 1, 2)], IV)
    m = intervals.merge(df)
    assert rows(m) == [("c", "+", 0, 12, 3), ("c", "+", 20, 25, 1), ("d", "-", 1, 2, 1)]
    assert rows(intervals.merge(df, slack=-1), "start", "stop") == [(0, 10), (1, 2), (10, 12), (20, 25)]
    assert rows(intervals.gaps(m)) == [("c", "+", 12, 20)]


def test_binned_joins_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    mk = lambda n: [("c", "+-"[i % 2], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 300, n), rng.integers(1, 60, n)))]
    a, b = sorted(set(mk(60))), sorted(set(mk(50)))
    for how, test in (("overlap", lambda x, y: x[2] < y[3] and y[2] < x[3]), ("contains", lambda x, y: y[2] >= x[2] and y[3] <= x[3])):
        got = rows(intervals.overlap_join(frame(spark, a, IV), frame(spark, b, IV), how=how, width=16), "strand", "start", "stop", "r_start", "r_stop")
        assert got == sorted((x[1], x[2], x[3], y[2], y[3]) for x in a for y in b if x[1] == y[1] and test(x, y))


def test_band_counts_many_to_many(spark):
    p = frame(spark, [("c", "+", 10, 20), ("c", "+", 11, 21), ("c", "+", 90, 99), ("c", "+", 10, 20)], IV)
    t = frame(spark, [("c", "+", 10, 21), ("c", "+", 50, 60)], IV)
    assert rows(intervals.band_counts(p, t, 1)) == [(2, 1, 1)]
    assert rows(intervals.band_counts(p, t, 0)) == [(0, 3, 2)]
    empty = frame(spark, [], IV)
    assert rows(intervals.band_counts(empty, t, 2)) == [(0, 0, 2)]


def test_clusters_count_every_interval_once(spark):
    p = frame(spark, [(1, "c", "+", 0, 10), (2, "c", "+", 50, 60), (3, "c", "-", 0, 10)], "id int, " + IV)
    t = frame(spark, [(7, "c", "+", 5, 55), (8, "c", "+", 100, 110)], "id int, " + IV)
    got = rows(intervals.clusters(p, t))
    assert got == sorted([("pred", "1", "pred:1"), ("pred", "2", "pred:1"), ("pred", "3", "pred:3"), ("true", "7", "pred:1"), ("true", "8", "true:8")])


def test_clusters_against_all_pairs(spark):
    rng = np.random.default_rng(12)
    for n, span in ((40, 400), (60, 250), (30, 60)):
        side = lambda m: [(i, "c", "+-"[i % 2], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, span, m), rng.integers(1, 14, m)))]
        p, t = side(n), side(n - 7)
        nodes = {f"pred:{r[0]}": r for r in p} | {f"true:{r[0]}": r for r in t}
        label = {k: k for k in nodes}
        for _ in range(2 * n):
            for a, x in nodes.items():
                for b, y in nodes.items():
                    if a[0] != b[0] and x[2] == y[2] and x[3] < y[4] and y[3] < x[4]:
                        label[a] = label[b] = min(label[a], label[b])
        got = intervals.clusters(frame(spark, p, "id int, " + IV), frame(spark, t, "id int, " + IV)).collect()
        assert {f"{r.side}:{r.id}": r.cluster for r in got} == label


def labels(spark, values, key="k"):
    return frame(spark, [(key, i, v) for i, v in enumerate(values)], "grp string, pos long, label int")


def test_true_runs_and_mask(spark):
    v = [1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 1, 1]
    df = labels(spark, v).withColumn("ok", F.col("pos") != 6)
    assert rows(runs.true_runs(df, ["grp"], "label"), "start", "stop") == [(0, 1), (3, 4), (5, 7), (9, 12)]
    assert rows(runs.true_runs(df, ["grp"], "label", "ok"), "start", "stop") == [(0, 1), (3, 4), (9, 12)]


def test_group_runs(spark):
    r = runs.runs(labels(spark, [0, 1, 1, 1, 0, 2, 2, 3, 0]), ["grp"])
    assert rows(runs.group_runs(r, ["grp"], {"a": [1, 2], "b": [3], "c": [2, 3]}), "entity", "start", "stop") == [("a", 1, 4), ("a", 5, 7), ("b", 7, 8), ("c", 5, 8)]


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_runs_and_tags_across_blocks(spark, block):
    rng = np.random.default_rng(13)
    v = rng.integers(-1, 3, 60).repeat(rng.integers(1, 6, 60))[:90].tolist()
    df = labels(spark, v).unionByName(labels(spark, v[::-1], "m"))
    whole = lambda f: rows(f(1 << 20))
    for f in (lambda b: runs.runs(df, ["grp"], block=b).select("grp", "label", "start", "stop"), lambda b: runs.true_runs(df.withColumn("ok", F.col("pos") % 9 != 4), ["grp"], "label", "ok", block=b), lambda b: runs.biluo(df, ["grp"], block=b), lambda b: runs.biluo(df, ["grp"], forward=False, block=b)):
        assert rows(f(block)) == whole(f)
    cut = [0, *[i for i in range(1, 90) if v[i] != v[i - 1]], 90]
    assert [r[1:] for r in rows(runs.runs(df, ["grp"], block=block), "grp", "start", "label", "stop") if r[0] == "k"] == [(a, v[a], b) for a, b in zip(cut, cut[1:])]


def test_biluo_round_trip(spark):
    v = [0, 1, 0, 2, 2, 0, 3, 0, 1, 1, 1, -1]
    t = runs.biluo(labels(spark, v), ["grp"]).withColumn("back", runs.biluo_class(F.col("tag"))).orderBy("pos").collect()
    assert [r.tag for r in t] == [0, 4, 0, 5, 7, 0, 12, 0, 1, 2, 3, -1]
    assert [r.back for r in t] == v


def test_biluo_names(spark):
    n = frame(spark, [(i,) for i in (-1, 0, 6, 4, 9)], "t int").select(runs.biluo_name(F.col("t"), ["GENE", "PROTEIN"]).alias("n")).collect()
    assert [r.n for r in n] == ["MASK", "O", "I-PROTEIN", "U-GENE", None]


@pytest.mark.parametrize("length", [8, 16, 1931, 8211])
def test_windows_tile_the_sequence(spark, length):
    df = frame(spark, [(length,)], "n long").withColumn("l", runs.padded_length(F.col("n"), 8, 4))
    w = runs.index_windows(df, "l", 8, 4).orderBy("start").collect()
    assert w[0].v_start == 0 and w[-1].v_stop == w[-1].l >= length
    assert all(a.v_stop == b.v_start for a, b in zip(w, w[1:]))
    if length == 16:
        assert [(r.start, r.stop, r.v_start, r.v_stop) for r in w] == [(0, 8, 0, 6), (4, 12, 6, 10), (8, 16, 10, 16)]


def test_partition_bounds(spark):
    v = [0, 0, 1, 1, 1, 0, 1, 1, 1, 0, 0]
    df = labels(spark, v).withColumnRenamed("label", "v")
    got = rows(runs.partition_bounds(df, ["grp"], 1, 4), "start", "stop")
    assert got[0][0] == 0 and got[-1][1] == len(v) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(b - a >= 4 for a, b in got[:-1])


def test_transitions(spark):
    r = runs.runs(labels(spark, [0, 0, 1, 1, 1, 0]), ["grp"])
    assert rows(runs.transitions(r, ["grp"], 2), "from_state", "to_state", "n") == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)]


TREE = "id string, parent string, type string, seq string, strand string, start long, stop long, canonical string, row long"


def tree(spark):
    return frame(spark, [
        ("g1", None, "gene", "c", "+", 0, 50, None, 0), ("m1", "g1", "mRNA", "c", "+", 0, 50, "0", 1), ("m2", "g1", "mRNA", "c", "+", 0, 50, "1", 2),
        ("p1", "m1", "CDS", "c", "+", 9, 16, None, 3), ("p2", "m1", "CDS", "c", "+", 29, 38, None, 4), ("p3", "m2", "five_prime_UTR", "c", "+", 0, 5, None, 5),
        ("g2", None, "gene", "c", "-", 60, 99, None, 6), ("m3", "g2", "mRNA", "c", "-", 60, 99, "1", 7), ("p4", "m3", "CDS", "c", "-", 70, 78, None, 8), ("p5", "m3", "CDS", "c", "-", 80, 87, None, 9),
    ], TREE)


def test_cascade_of_a_deep_tree(spark):
    df = frame(spark, [(f"n{i}", f"n{i - 1}" if i else None, "gene", "c", "+", 0, 1, None, i) for i in range(12)] + [("z", None, "gene", "c", "+", 0, 1, None, 12)], TREE)
    assert rows(hierarchy.cascade_delete(df, df.where("id = 'n0'").select("id")), "id") == [("z",)]


def test_whole_text_queries(spark):
    from strandloom.plans.catalogue import QUERIES
    from strandloom.plans.fixtures import view

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    dna = {r.doc_id: r.dna for r in view(spark, sf, "dna").collect()}
    flag = lambda s: len(s) % 3 == 0 and not {s[k : k + 3] for k in range(0, len(s), 3)} & {"TAA", "TAG", "TGA"}
    want = {i: flag(s if i % 2 else s.replace("T", "C")) for i, s in dna.items()}
    got = {r.doc_id: r.orf for r in QUERIES["orf_flag_whole"](spark, sf).collect()}
    assert got == want and any(want[i] for i in dna if len(dna[i]) > 200)
    cut = {i: "".join(s[k * 40 + 10 : k * 40 + 30] for k in range(len(s) // 40)) for i, s in dna.items()}
    want = {i: s if i % 2 == 0 else s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in cut.items()}
    assert {r.doc_id: r.s for r in QUERIES["spliced_sequence_whole"](spark, sf).collect()} == want


def test_cascade_with_cycle(spark):
    df = frame(spark, [("a", "b", "gene", "c", "+", 0, 1, None, 0), ("b", "a", "mRNA", "c", "+", 0, 1, None, 1), ("z", None, "gene", "c", "+", 0, 1, None, 2)], TREE)
    assert rows(hierarchy.cascade_delete(df, df.where("id = 'a'").select("id")), "id") == [("z",)]


def test_representative_ties_and_flags(spark):
    assert rows(hierarchy.representative(tree(spark))) == [("m1", "g1"), ("m3", "g2")]
    assert rows(hierarchy.representative(tree(spark), "annotated_or_longest")) == [("m2", "g1"), ("m3", "g2")]


def test_phase_both_strands(spark):
    got = rows(hierarchy.cds_phase(tree(spark).where("type = 'CDS'")), "id", "phase")
    assert got == [("p1", 0), ("p2", 2), ("p4", 2), ("p5", 0)]


def test_bounds_and_valid_genes(spark):
    assert rows(hierarchy.propagate_bounds(tree(spark)).where("type = 'gene'"), "id", "start", "stop") == [("g1", 0, 38), ("g2", 70, 87)]
    assert rows(filters.valid_genes(tree(spark)).where("type = 'mRNA'"), "id") == [("m1",), ("m3",)]
    assert filters.valid_genes(tree(spark), True).count() == 0


def test_filter_features_with_nothing_to_filter(spark):
    parts = [("sp", "c", "+", "g", 0, 90, "t", 0, 90, "1", f"f{i}", k, 30 * i, 30 * i + 10) for i, k in enumerate(("five_prime_UTR", "CDS", "three_prime_UTR"))]
    wide = frame(spark, parts, "species string, seq string, strand string, gene_id string, gene_start long, gene_stop long, transcript_id string, transcript_start long, transcript_stop long, canonical string, feature_id string, feature_type string, feature_start long, feature_stop long")
    kept, log = filters.filter_features(wide)
    assert kept.count() == 3 and log.count() == 0


def test_orphans_and_duplicate_ids(spark):
    df = frame(spark, [("a", "x", "CDS", "c", "+", 0, 5, None, 0), ("b", "x", "CDS", "c", "+", 9, 12, None, 1), ("c", "y", "CDS", "c", "-", 9, 12, None, 2)], TREE)
    got = rows(hierarchy.attach_orphans(df), "id", "parent", "type", "start", "stop")
    assert ("x", None, "inferred_parent", 0, 12) in got and ("c", None, "CDS", 9, 12) in got
    d = frame(spark, [("p", None, "gene", "c", "+", 0, 9, None, 0), ("p", None, "gene", "c", "+", 20, 40, None, 1), ("k", "p", "CDS", "c", "+", 22, 30, None, 2)], TREE)
    assert rows(hierarchy.remap_duplicate_ids(d).where("id = 'k'"), "parent") == [("p_2",)]


def test_dna(spark):
    df = frame(spark, [("ATGAAATAA",), ("ATGTAATAA",), ("ATGAAATA",), ("CCCAAATAA",), ("",)], "s string")
    got = df.select(D.is_complete_orf(F.col("s")), D.translate(F.col("s")), D.reverse_complement(F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
    assert got[0][1] == "MK*" and got[0][2] == "TTATTTCAT"


def test_attributes(spark):
    df = frame(spark, [("ID=g;Name=T G;x=a=b;ID=h",), ("",), (None,)], "s string")
    m = [r[0] for r in df.select(A.parse(F.col("s"))).collect()]
    assert m == [{"ID": "h", "Name": "T G", "x": "a=b"}, {}, {}]
    with pytest.raises(Exception, match="attribute without"):
        frame(spark, [("InvalidPair",)], "s string").select(A.parse(F.col("s"))).collect()
    p = frame(spark, [("ID=a;Parent=b,c;geneID=d",)], "s string").select(A.prefix_ids(F.col("s"), "x_")).first()[0]
    assert p == "ID=x_a;Parent=x_b,x_c;geneID=d"


def test_merged_keys(spark):
    df = frame(spark, [("c1", ["a", "b"], "+")], "c string, g array<string>, s string")
    key = df.select(A.merged_key(F.col("c"), F.col("g"), F.col("s")).alias("k"))
    assert key.first().k == "c1~a|b~+"
    assert key.unionByName(frame(spark, [("odd",)], "k string")).select(A.split_merged_key(F.col("k")).alias("x")).collect() == [((("c1", ["a", "b"], "+")),), (None,)]


@pytest.mark.parametrize("name, want", [("arabidopsis thaliana", "Athaliana"), ("ZEA MAYS", "Zmays"), ("yeast", "yeast"), ("  ", ""), (None, "")])
def test_species_id(spark, name, want):
    assert frame(spark, [(name,)], "n string").select(A.species_id(F.col("n"))).first()[0] == want


def test_viterbi_against_all_paths(spark):
    rng = np.random.default_rng(5)
    for n, t in ((5, 6), (3, 7)):
        m, e, s = rng.dirichlet(np.ones(n), n), rng.dirichlet(np.ones(n), t), rng.dirichlet(np.ones(n))
        want = decode.every_path(e, m, s)
        assert (decode.viterbi(e, m, s) == want).all()
    df = frame(spark, [("a", i, e[i].tolist()) for i in range(t)], "k string, pos long, probs array<double>")
    for block in (1, 2, 3, 100):
        got = [r.state for r in decode.viterbi_paths(df, ["k"], m, s, block=block).orderBy("pos").collect()]
        assert got == want.tolist()


def test_viterbi_in_rounds(spark):
    """Blocks combined two at a time over several rounds, sequences of different lengths, one of them a single place: as in one pass."""
    rng = np.random.default_rng(11)
    m, start = rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(4))
    seqs = {k: rng.dirichlet(np.ones(4) * 0.05, n) for k, n in (("a", 83), ("b", 1), ("c", 16), ("d", 40))}
    df = spark.createDataFrame([(k, i, [float(x) for x in p]) for k, e in seqs.items() for i, p in enumerate(e)], "k string, pos long, probs array<double>").repartition(3)
    for block, fan in ((4, 2), (4, 3), (7, 256), (100, 256)):
        got = {}
        for r in decode.viterbi_paths(df, ["k"], m, start, block=block, fan=fan).orderBy("pos").collect():
            got.setdefault(r.k, []).append(r.state)
        assert got == {k: decode.viterbi(e, m, start).tolist() for k, e in seqs.items()}
    assert decode.viterbi_paths(df.limit(0), ["k"], m, start).collect() == []


def test_viterbi_of_many_blocks_at_once():
    rng = np.random.default_rng(14)
    m, start = rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(4))
    size = np.array([7, 1, 30, 12, 30])
    parts = [rng.dirichlet(np.ones(4), k) for k in size]
    flat, tr, first = np.concatenate(parts).ravel(), np.log(m + decode.EPS), np.log(start + decode.EPS)
    p = decode.products(flat, size, np.array([True, False, False, True, False]), tr, first)
    paths = np.split(decode.traces(flat, size, np.array([-1, 2, 0, -1, 3]), np.array([1, 0, 3, 2, 2]), tr, first), np.cumsum(size)[:-1])
    for k, e in enumerate(parts):
        e = np.log(e + decode.EPS)
        score = np.where(np.eye(4, dtype=bool), (first + e[0])[:, None], -np.inf) if k in (0, 3) else tr + e[0]
        for row in e[1:]:
            score = (score[:, :, None] + tr).max(axis=1) + row
        assert np.allclose(p[k], score)
        a, z = (-1, 2, 0, -1, 3)[k], (1, 0, 3, 2, 2)[k]
        path = paths[k]
        own = (first[path[0]] if a < 0 else tr[a, path[0]]) + e[0, path[0]] + sum(tr[path[t - 1], path[t]] + e[t, path[t]] for t in range(1, len(e)))
        best = p[k][:, z].max() if a < 0 else p[k][a, z]
        assert path[-1] == z and np.isclose(own, best)


def test_gene_pair_levels(spark):
    """Two true genes meet one predicted gene; a third true gene has no partner. Shared intervals count once, longest ones by transcript."""
    def t(gene, start, stop, *transcripts):
        out = [(gene, None, "gene", "c", "+", start, stop, None, 0)]
        for k, parts in enumerate(transcripts):
            out += [(f"{gene}m{k}", gene, "mRNA", "c", "+", start, stop, None, k + 1)]
            out += [(f"{gene}m{k}p{i}", f"{gene}m{k}", "CDS", "c", "+", a, b, None, 10 * k + i) for i, (a, b) in enumerate(parts)]
        return out

    pred = frame(spark, t("a", 0, 100, [(0, 10), (20, 30)], [(0, 10), (20, 30), (40, 60)]), TREE)
    true = frame(spark, t("x", 0, 35, [(0, 10), (20, 30)]) + t("y", 38, 100, [(40, 60), (70, 80)]) + t("z", 500, 600, [(500, 510)], [(500, 510), (520, 530)]), TREE)
    got = {r.level: (r.tp, r.fp, r.fn) for r in evaluate.transcript_levels(pred, true).collect()}
    assert got == {
        "transcript_cds": (1, 0, 2), "transcript_intron": (1, 0, 2), "transcript": (1, 0, 2), "exon_cds": (3, 0, 4), "exon": (3, 0, 4), "intron_cds": (1, 1, 2), "intron": (1, 1, 2),
        "exon_cds_longest": (3, 0, 3), "exon_longest": (3, 0, 3), "intron_cds_longest": (1, 1, 2), "intron_longest": (1, 1, 2),
    }


def test_blocks_and_motifs(spark):
    from strandloom.sources import fasta

    dna = "".join(np.random.default_rng(15).choice(list("ACGT"), 40000))
    seq = frame(spark, [("c", dna), ("d", ""), ("e", "ACG")], "seq string, dna string")
    got = {(r.seq, r.block): r.dna for r in fasta.blocks(seq, 7, 2).where("seq <> 'c'").collect()}
    assert got == {("e", 0): "ACG"}
    pieces = fasta.blocks(seq, 8192, 1)
    at = [0, 8191, 8192, 16383, 39998, 39999]
    found = fasta.bases_at(frame(spark, [("c", i) for i in at], "seq string, at long"), pieces, {"b": F.col("at")}, 2, 8192)
    assert rows(found, "at", "b") == [(i, dna[i : i + 2]) for i in at]
    introns = frame(spark, [("c", "+", a, a + 50) for a in (8142, 8191, 100, 39950, 39960)], IV)
    want = {}
    for a in (8142, 8191, 100, 39950):
        m = f"{dna[a : a + 2]}-{dna[a + 48 : a + 50]}"
        want[m if m in ("GT-AG", "GC-AG") else "other"] = want.get(m if m in ("GT-AG", "GC-AG") else "other", 0) + 1
    assert {r.motif: r.n for r in evaluate.splice_motifs(introns, seq).collect()} == want


def test_priors_are_stochastic():
    for k in decode.PRIORS:
        m, start = decode.checked(decode.priors(*k), None, 5)
        assert np.allclose(m.sum(axis=1), 1) and np.isclose(start.sum(), 1)
    with pytest.raises(ValueError):
        decode.priors("fungi")


def genes(spark, data):
    return frame(spark, data, "seq string, strand string, gene string, start long, stop long, cds string, donor string, acceptor string")


def test_orf_chains(spark):
    far = lambda g, s, cds: ("c", "+", g, s, s + len(cds), cds, "AA", "AA")
    g = genes(spark, [far("a", 0, "ATGAAA"), far("b", 100, "CCCTAA"), far("d", 200, "ATGCCCTGA"), far("e", 300, "CCC")])
    assert rows(orf.orf_chains(g), "members", "cds") == [(["a", "b"], "ATGAAACCCTAA"), (["d"], "ATGCCCTGA")]
    near = genes(spark, [("c", "+", "a", 0, 6, "ATGAAA", "GT", "AA"), ("c", "+", "b", 7, 14, "ACCCTAA", "AA", "AG")])
    assert rows(orf.orf_chains(near), "members", "cut", "cds") == [(["a", "b"], 1, "ATGAAACCCTAA")]


@pytest.mark.parametrize("block,halo", [(1024, 64), (4, 1), (3, 2)])
def test_orf_chains_over_blocks(spark, block, halo):
    """Random genes on both strands, chains of up to twelve genes, ties of places: as one fold over each strand."""
    import random
    from types import SimpleNamespace

    rng = random.Random(block)
    data, n = [], 0
    for seq in ("a", "b"):
        for strand in "+-":
            at = 0
            for _ in range(25):
                size = rng.choice([1, 1, 2, 3, 12])
                for k in range(size):
                    body = "".join(rng.choice(["AAA", "CCC", "GGA", "TTC"]) for _ in range(rng.randrange(1, 4)))
                    head, tail = "ATG" if (k == 0) == (rng.random() < 0.9) else "", rng.choice(["TAA", "TGA"]) if (k == size - 1) == (rng.random() < 0.9) else ""
                    cds = rng.choice(["", "A", head + body + tail]) if rng.random() < 0.1 else head + body + tail
                    data.append((seq, strand, f"g{n}", at, at + 10, cds, rng.choice(["GT", "AA"]), rng.choice(["AG", "AA"])))
                    at += rng.choice([0, 9, 10, 11, 300])
                    n += 1
    names = ["seq", "strand", "gene", "start", "stop", "cds", "donor", "acceptor"]
    want = set()
    for key in {d[:2] for d in data}:
        rows_ = [SimpleNamespace(**dict(zip(names, d, strict=True))) for d in sorted((d for d in data if d[:2] == key), key=lambda d: (d[3], d[4], d[2]), reverse=key[1] == "-")]
        whole = [orf.complete(r.cds) for r in rows_]
        for i in range(len(rows_)):
            if (made := orf._chain(rows_, i, whole)) and made != orf.OPEN:
                want.add((*key, tuple(r.gene for r in rows_[i : made[0] + 1]), made[2], made[1]))
    got = [(r.seq, r.strand, tuple(r.members), r.cut, r.cds) for r in orf.orf_chains(genes(spark, data), block, halo).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(len(w[2]) for w in want) > 8


def test_apply_merges(spark):
    t = tree(spark).select("id", "parent", "type", "seq", "strand", "start", "stop", "row")
    t = t.unionByName(frame(spark, [("g9", None, "gene", "c", "+", 52, 58, 20), ("m9", "g9", "mRNA", "c", "+", 52, 58, 21), ("p9", "m9", "CDS", "c", "+", 52, 58, 22)], "id string, parent string, type string, seq string, strand string, start long, stop long, row long"))
    out = orf.apply_merges(t, frame(spark, [(["g1", "g9"],)], "members array<string>"))
    assert rows(out.where("type = 'gene'"), "id", "start", "stop") == [("concat_g1_g9", 0, 58), ("g2", 60, 99)]
    assert rows(out.where("type = 'CDS' and strand = '+'"), "parent", "start", "phase") == [("concat_g1_g9.t1", 9, 0), ("concat_g1_g9.t1", 29, 2), ("concat_g1_g9.t1", 52, 2)]


def test_prf_zero_safe(spark):
    got = evaluate.prf(frame(spark, [(0, 0, 0), (2, 1, 1)], "tp long, fp long, fn long")).collect()
    assert (got[0].precision, got[0].recall, got[0].f1) == (0.0, 0.0, 0.0)
    assert got[1].f1 == pytest.approx(2 / 3)


def test_prediction_end_to_end(spark):
    """A scorer that marks upper-case letters by class finds the planted transcript on both strands."""
    from strandloom.plans import pipelines

    state = {"A": 0, "T": 0, "C": 3, "G": 3, "N": 0}
    dna = "A" * 40 + "C" * 60 + "A" * 50
    score = lambda batch: [np.eye(5)[[state[b] for b in s]] * 9 for s in batch]
    got = pipelines.predict(frame(spark, [("c", dna)], "seq string, dna string"), score, window=64, stride=32, complete=False)
    assert rows(got, "type", "strand", "start", "stop") == sorted((t, s, 40, 100) for t in ("gene", "mRNA", "CDS") for s in "+-")
    ev = pipelines.evaluate_trees(got.withColumn("row", F.lit(0).cast("long")), got.withColumn("row", F.lit(0).cast("long")))
    assert all(r.fp == r.fn == 0 for r in ev.collect())


def test_prepare_labels_cover_the_domain(spark):
    from strandloom.operators import labels as LB
    from strandloom.plans import pipelines

    t = [("g", None, "gene", 10, 100), ("m", "g", "mRNA", 10, 100), ("a", "m", "five_prime_UTR", 10, 20), ("b", "m", "CDS", 30, 60), ("d", "m", "three_prime_UTR", 80, 100)]
    df = frame(spark, [(i, p, k, "c", "+", a, b, "1" if k == "mRNA" else None, n) for n, (i, p, k, a, b) in enumerate(t)], TREE)
    out = pipelines.prepare(df)
    assert out["log"].count() == 0
    assert rows(out["layers"], "label", "start", "stop") == [("CDS", 30, 60), ("five_prime_UTR", 10, 20), ("intergenic", 0, 10), ("intron", 20, 30), ("intron", 60, 80), ("three_prime_UTR", 80, 100)]
    assert rows(LB.one_hot_errors(out["layers"], frame(spark, [("c", "+", 0, 100)], "seq string, strand string, lo long, hi long")), "uncovered", "extra") == [(0, 0)]


def raises(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_invalid_trees_raise(spark):
    t = tree(spark)
    raises(hierarchy.flatten(t.withColumn("type", F.when(F.col("id") == "p1", "tRNA").otherwise(F.col("type")))), "unknown feature type tRNA")
    assert hierarchy.flatten(t.withColumn("type", F.when(F.col("id") == "p1", "tRNA").otherwise(F.col("type"))), strict=False).count() == 4
    raises(hierarchy.representative(t, "annotated", allowed=("", "1")), "invalid value of canonical: 0")
    with pytest.raises(ValueError):
        hierarchy.representative(t.drop("canonical"), "annotated")
    assert rows(hierarchy.representative(t.drop("canonical"), "annotated_or_longest")) == [("m1", "g1"), ("m3", "g2")]
    d = frame(spark, [("p", None, "gene", "c", "+", 0, 9, None, 0), ("p", None, "gene", "c", "+", 20, 40, None, 1), ("k", "p", "CDS", "c", "+", 5, 30, None, 2)], TREE)
    raises(hierarchy.remap_duplicate_ids(d), "no parent contains the child of p")
    raises(spark.range(1).select(D.tokens(F.lit("AC-"), {"A": 0, "C": 1}, 4, strict=True)), "unmapped base -")


def test_terminal_introns_raise(spark):
    ddl = "seq string, strand string, gene long, t_start long, t_stop long, entity string, start long, stop long"
    inner = [("c", "+", 1, 0, 30, "CDS", 0, 10), ("c", "+", 1, 0, 30, "intron", 10, 20), ("c", "+", 1, 0, 30, "CDS", 20, 30)]
    assert hierarchy.emit_features(frame(spark, inner, ddl), strip_introns=False).count() == 4
    outer = frame(spark, [*inner[:2], ("c", "+", 2, 40, 50, "CDS", 40, 50)], ddl)
    raises(hierarchy.emit_features(outer, strip_introns=False), "terminal introns")
    assert rows(hierarchy.emit_features(outer).where("type = 'gene'"), "start", "stop") == [(0, 10), (40, 50)]


def test_genes_of_several_spans_raise(spark):
    parts = [("sp", "c", "+", "g", i, 90, "t", 0, 90, "1", f"f{i}", k, 30 * i, 30 * i + 10) for i, k in enumerate(("CDS", "CDS"))]
    wide = frame(spark, parts, "species string, seq string, strand string, gene_id string, gene_start long, gene_stop long, transcript_id string, transcript_start long, transcript_stop long, canonical string, feature_id string, feature_type string, feature_start long, feature_stop long")
    raises(filters.filter_features(wide)[1], "several values of gene_start")


def test_cut_across_blocks(spark):
    from strandloom.sources import fasta

    dna = "".join(np.random.default_rng(3).choice(list("ACGT"), 1000))
    seq = frame(spark, [("c", dna), ("d", "")], "seq string, dna string")
    places = [("a", "c", 5, 6), ("a", "c", 90, 310), ("a", "c", 90, 310), ("b", "c", 100, 200), ("e", "c", 990, 1200), ("f", "c", 2000, 2010), ("g", "d", 0, 4), ("h", "x", 0, 4), ("i", "c", 7, 7)]
    got = {r.k: r.dna for r in fasta.cut(frame(spark, places, "k string, seq string, start long, stop long"), fasta.blocks(seq, 100), ("k",), 100).collect()}
    assert got == {"a": dna[5:6] + dna[90:310], "b": dna[100:200], "e": dna[990:], "f": "", "g": "", "h": "", "i": ""}


def test_masks_by_reason(spark):
    from strandloom.operators import labels

    ddl = "seq string, strand string, reason string, start long, stop long"
    log = frame(spark, [("c", "+", "overlapping_gene", 100, 200), ("c", "+", "incomplete_features", 300, 400), ("c", "-", "incomplete_features", 300, 400)], ddl)
    all_genes = frame(spark, [("c", "+", 100, 200), ("c", "+", 300, 400), ("c", "+", 420, 500), ("c", "-", 300, 400)], IV)
    domain = frame(spark, [("c", "+", 0, 1000), ("c", "-", 0, 450)], "seq string, strand string, lo long, hi long")
    flanks = [("+", "incomplete_features", 250, 300), ("+", "incomplete_features", 400, 420), ("-", "incomplete_features", 200, 300), ("-", "incomplete_features", 400, 450)]
    inner = [("+", "incomplete_features", 300, 400), ("-", "incomplete_features", 300, 400)]
    other = [("+", "overlapping_gene", 100, 200)]
    cols = ("strand", "reason", "start", "stop")
    assert rows(labels.reason_masks(log, all_genes, domain, up=50, down=100), *cols) == sorted(flanks + inner + other)
    assert rows(labels.reason_masks(log, all_genes, domain, False, 50, 100), *cols) == sorted(flanks + other)
    assert labels.reason_masks(log.limit(0), all_genes, domain).count() == 0
    with pytest.raises(ValueError):
        labels.reason_masks(log, all_genes, domain, up=0)


def test_datasets(spark, tmp_path):
    from strandloom.operators import dataset

    labels = frame(spark, [("s", i, v) for i, v in enumerate((1, 1, 1, 0, 2, 2, -1, 3))], "k string, pos long, label int")
    for block in (2, 3, 100):
        got = {r.block: r.tag for r in dataset.block_tags(dataset.pack(labels, ["k"], "label", block), ["k"]).collect()}
        assert [v for b in sorted(got) for v in got[b]] == [1, 2, 3, 0, 5, 7, -1, 12]
        back = {r.block: r.tag for r in dataset.block_tags(dataset.pack(labels, ["k"], "label", block), ["k"], forward=False).collect()}
        assert [v for b in sorted(back) for v in back[b]] == [3, 2, 1, 0, 7, 5, -1, 12]
    tokens = lambda n: dataset.pack(frame(spark, [("s", i, i % 4) for i in range(n)], "k string, pos long, token int"), ["k"], "token", 3)
    packed = dataset.pack(labels, ["k"], "label", 3)
    made = dataset.label_tokens(packed, tokens(11), ["k"]).orderBy("block").collect()
    assert [v for r in made for v in r.token] == [i % 4 for i in range(8)] and [v for r in made for v in r.label] == [1, 1, 1, 0, 2, 2, -1, 3]
    for short in (7, 5):
        raises(dataset.label_tokens(packed, tokens(short), ["k"]), "more labels than tokens")
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, a string"), frame(spark, [(1, "p"), (2, "q")], "k int, b string")
    assert rows(dataset.exact_join(a, b, ["k"])) == [(1, "x", "p"), (2, "y", "q")]
    raises(dataset.exact_join(a, b.where("k = 1"), ["k"]), "not aligned")
    raises(dataset.exact_join(a.where("k = 1"), b, ["k"]), "not aligned")
    for rank in (10, 2, 1):
        labels.where(F.col("pos") % 3 == rank % 3).withColumn("rank", F.lit(rank)).write.mode("overwrite").parquet(str(tmp_path / f"predictions.{rank}.parquet"))
    shards = dataset.read_shards(spark, str(tmp_path))
    assert [s.first()["rank"] for s in shards] == [1, 2, 10]
    raises(dataset.merge_shards(shards, ["k"]), "gaps or repeats")
    rest = labels.where("pos % 3 = 0").withColumn("rank", F.lit(0))
    assert dataset.merge_shards([*shards[:2], rest], ["k"]).count() == 8
    with pytest.raises(FileNotFoundError):
        dataset.read_shards(spark, str(tmp_path / "none"))
    x = frame(spark, [(3, [1, 2, 3]), (1, [4]), (2, [])], "i int, v array<int>")
    assert rows(dataset.samples(x, ["i"], 2, 2)) == [(1, [4]), (2, [])] and rows(dataset.samples(x, ["i"], None, 2))[2] == (3, [1, 2])
    y = frame(spark, [("a", 5), ("b", 9), ("c", 5), ("d", 1)], "id string, n int")
    assert rows(dataset.strided(y, "n", "id", 2), "id", "worker") == [("a", 1), ("b", 0), ("c", 0), ("d", 1)]
