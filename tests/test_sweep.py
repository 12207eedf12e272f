"""Sweeps in blocks of a few places against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import intervals
from strandloom.operators.sweep import Take, running

DDL = "seq string, strand string, start long, stop long, id string"


def some(seed, n=70, prefix=""):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(60)
        out.append((rng.choice(["a", "b", None]), rng.choice("+-"), start, start + rng.choice([0, 1, 1, 2, 3, 9]), f"{prefix}{i}"))
    return out + out[:3]


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


@pytest.mark.parametrize("seed,width", [(1, 3), (2, None), (3, 1 << 20)])
def test_interval_sweeps(spark, seed, width):
    rows = some(seed)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    flagged = sorted((str(r.seq), r.strand, r.start, r.stop, r.id, r.has_overlap) for r in intervals.overlap_flag(df.where("start < stop"), width=width).collect())
    full = [r for r in rows if r[2] < r[3]]
    assert flagged == sorted((str(r[0]), *r[1:], sum(q[:2] == r[:2] and q[2] < r[3] and r[2] < q[3] for q in full) > 1) for r in full)
    for slack in (0, -1, 2):
        want = []
        for k, g in groups(rows).items():
            merged = []
            for r in sorted(g, key=lambda r: r[2:4]):
                if merged and r[2] <= merged[-1][1] + slack:
                    merged[-1] = [merged[-1][0], max(merged[-1][1], r[3]), merged[-1][2] + 1]
                else:
                    merged.append([r[2], r[3], 1])
            want += [(str(k[0]), k[1], *m) for m in merged]
        one = intervals.merge(df, slack=slack, width=width)
        assert sorted((str(r.seq), r.strand, r.start, r.stop, r.n_members) for r in one.collect()) == sorted(want)
        if slack == 0:
            ends = {}
            for s, t, a, b, _ in sorted(want):
                ends.setdefault((s, t), []).append((a, b))
            between = sorted((*k, x[1], y[0]) for k, v in ends.items() for x, y in zip(v, v[1:], strict=False))
            assert sorted((str(r.seq), r.strand, r.start, r.stop) for r in intervals.gaps(one, width=width).collect()) == between
    t = some(seed + 10)
    near = intervals.nearest(df, spark.createDataFrame(t, DDL).select("seq", "strand", "start", "stop"), width=width)
    assert near.columns == ["seq", "strand", "start", "stop", "id", "upstream_stop", "downstream_start"]
    want = [(str(r[0]), *r[1:], max((q[3] for q in t if q[:2] == r[:2] and q[3] < r[2]), default=None), min((q[2] for q in t if q[:2] == r[:2] and q[2] > r[3]), default=None)) for r in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.seq), *tuple(r)[1:]) for r in near.collect()), key=key) == sorted(want, key=key)
    numbered = [(*r, i) for i, r in enumerate(rows)]
    bad = {(r.seq, r.n_bad) for r in intervals.out_of_order(spark.createDataFrame(numbered, DDL + ", row long"), width=width).collect()}
    assert bad == {(s, sum(y < x for x, y in zip(g, g[1:], strict=False))) for s in {r[0] for r in rows} for g in [[r[2] for r in rows if r[0] == s]]}


@pytest.mark.parametrize("seed", [4, 5])
def test_clusters_in_blocks(spark, seed):
    rng = random.Random(seed)
    side = lambda p: [(rng.choice("ab"), "+", a := rng.randrange(80), a + rng.choice([1, 2, 5, 20]), f"{p}{i}") for i in range(25)]
    pred, true = side("p"), side("t")
    nodes = {("pred", r[4]): r for r in pred} | {("true", r[4]): r for r in true}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for p in pred:
        for t in true:
            if p[0] == t[0] and p[2] < t[3] and t[2] < p[3]:
                root[find(("pred", p[4]))] = find(("true", t[4]))
    least = {}
    for n in nodes:
        least[find(n)] = min(least.get(find(n), "~"), ":".join(n))
    got = intervals.clusters(spark.createDataFrame(pred, DDL), spark.createDataFrame(true, DDL), width=3)
    assert {(r.side, r.id): r.cluster for r in got.collect()} == {n: least[find(n)] for n in nodes}


def test_running_takes(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", None]), i, rng.choice([None, 1, 2, 3])) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    takes = {f"{k}{a:d}{h:d}": Take(k, F.col("v"), a, h) for k in ("max", "min", "sum", "near") for a in (False, True) for h in (False, True)}
    got = {r.i: r for r in running(df, ["g"], [F.col("i")], "i", takes, 4).collect()}
    assert len(got) == 50 and {r.i: r for r in running(df, ["g"], [F.col("i")], "i", takes, None).collect()} == got
    for g, i, v in rows:
        for name, t in takes.items():
            other = [w for h, j, w in rows if h == g and w is not None and ((j > i if t.ahead else j < i) or t.here and j == i)]
            want = {"max": max, "min": min, "sum": sum}[t.kind](other) if other and t.kind != "near" else (other[0] if t.ahead else other[-1]) if other else None
            assert got[i][name] == want, (name, i)


def test_running_keeps_the_names_asked_for(spark):
    """a result or a column of the rows may have a name that the sweep uses for itself."""
    df = spark.createDataFrame([("x", i, 2) for i in range(9)], "g string, i long, _kc0 long")
    got = running(df, ["g"], [F.col("i")], "i", {"_k": Take("sum", F.col("_kc0"), here=True), "_c0": Take("max", F.col("i"))}, 4)
    assert got.columns == ["g", "i", "_kc0", "_k", "_c0"]
    assert [tuple(r) for r in got.orderBy("i").collect()] == [("x", i, 2, 2 * i + 2, i - 1 if i else None) for i in range(9)]


@pytest.mark.parametrize("longest", [None, 12])
def test_replace_bracketed_in_blocks(spark, longest):
    from strandloom.operators import runs

    rng = random.Random(7)
    rows = []
    for g in ("a", "b", "c"):
        at = 0
        for _ in range(60):
            size = rng.randrange(1, 5)
            rows.append((g, rng.choice([0, 1, 2, 3, 3]), at, at + size))
            at += size
    want = []
    for g in ("a", "b", "c"):
        own = [list(r) for r in rows if r[0] == g]
        new = [r[1] for r in own]
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                if own[i][1] == 1 and own[j][1] == 2:
                    mid = [r[1] for r in own[i + 1 : j]]
                    if 3 in mid and not {1, 2} & set(mid) and (longest is None or own[j][3] - own[i][2] <= longest):
                        new[i : j + 1] = [9] * (j - i + 1)
        want += [(g, n, r[2], r[3]) for n, r in zip(new, own, strict=True)]
    df = spark.createDataFrame(rows, "g string, label int, start long, stop long").repartition(3)
    got = runs.replace_bracketed(df, ["g"], 1, 3, 2, 9, longest, width=5)
    assert sorted(tuple(r) for r in got.select("g", "label", "start", "stop").collect()) == sorted(want) and any(w[1] == 9 for w in want)
