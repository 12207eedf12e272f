"""Hard negatives, nearest neighbours and collocations against brute force in plain Python, with the cases of their docstrings."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import collocations, hard_negatives, nearest, vector_blocks

DDL = "vec_id long, embedding array<float>, label int, rank int, id long, _norm string, block string, score double"


def table(spark, rows, ddl=DDL):
    return spark.createDataFrame([(i, v, lab, 1, 7, "x", "y", 0.5) for i, v, lab in rows], ddl).repartition(5)


def some_rows(n=420, dim=12, seed=3):
    rng = random.Random(seed)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([rng.gauss(0, 1) * rng.choice([0.2, 1, 3]) for _ in range(dim)]), rng.randrange(4)) for i in range(n)]
    common = rows[10][1]
    rows += [(n + i, common, i % 2) for i in range(140)]  # a common vector
    rows += [(n + 200, None, 1), (n + 201, [1.0] * (dim - 1) + [None], 1), (n + 202, [float("nan")] * dim, 1), (n + 203, [float("inf")] * dim, 2), (n + 204, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(n + 300, [], 1), (n + 400, [], 2), (n + 350, [1.0, 2.0], 1), (n + 500, [1.0, 2.5], 1), (n + 600, [1.0, 2.0], 2), (n + 700, [0.0] * dim, 0), (n + 800, [-x for x in rows[0][1]], 0)]
    rows += [rows[50], rows[100], rows[100]]  # repeated rows
    return rows


def usable(rows):
    return {i: (v, lab) for i, v, lab in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}


def brute_negatives(rows, every=20):
    x = {i: ([math.floor(256 * a) for a in v], lab) for i, (v, lab) in usable(rows).items() if lab is not None}
    out = set()
    for a in (i for i in x if i % every == 0):
        s = sorted(((-sum(p * q for p, q in zip(x[a][0], v, strict=True)), i) for i, (v, _) in x.items() if i != a and len(v) == len(x[a][0])))
        for p, i in [(p, i) for p, i in s if x[i][1] == x[a][1]][:5]:
            ok = [(q, j) for q, j in s if x[j][1] != x[a][1] and 80 * -p <= 100 * -q <= 100 * -p][:5]
            out |= {(a, i, r + 1, j, -p, -q) for r, (q, j) in enumerate(ok)}
    return out


@pytest.mark.parametrize("block,bucket", [(8192, 1024), (7, 9)])
def test_hard_negatives(spark, monkeypatch, block, bucket):
    rows = some_rows()
    monkeypatch.setattr(vector_blocks, "BLOCK", block)
    monkeypatch.setattr(vector_blocks, "BUCKET", bucket)
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_negatives(rows) and len(found) > 100


def test_hard_negatives_beyond_doubles(spark):
    """Products that pass 2^53 are exact, those that pass a long are held at its ends."""
    rows = [(0, [3e6, 5e6 + 1], 0), (1, [3e6 + 2, 5e6], 0), (2, [3e6 - 1, 5e6 - 7], 1), (3, [3e6 - 1.5, 5e6 - 6.5], 1), (20, [3e30, 1.0], 2), (21, [2e30, 1.0], 2), (22, [2e30, 7.0], 3)]
    got = {tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows, DDL.replace("float", "double")), F.col("id") % 20 == 0).collect()}
    exact = lambda a, b: sum(math.floor(256 * p) * math.floor(256 * q) for p, q in zip(a, b, strict=True))
    most = 2**63 - 1
    assert {x for x in got if x[0] == 0} == {(0, 1, r, j, exact(rows[0][1], rows[1][1]), exact(rows[0][1], rows[j][1])) for r, j in enumerate(sorted((2, 3), key=lambda j: -exact(rows[0][1], rows[j][1])), 1)}
    assert (20, 21, 5, 22, most, most) in got  # after 0 to 3, which score as much


@pytest.mark.parametrize("block,bucket", [(8192, 1024), (7, 9)])
def test_nearest(spark, monkeypatch, block, bucket):
    rows = some_rows()
    monkeypatch.setattr(vector_blocks, "BLOCK", block)
    monkeypatch.setattr(vector_blocks, "BUCKET", bucket)
    got = nearest.nearest(table(spark, rows), F.col("id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    x = {i: v for i, (v, _) in usable(rows).items() if any(v)}

    def cosine(a, b):
        dot = aa = bb = 0.0
        for p, q in zip(a, b, strict=True):
            dot, aa, bb = dot + p * q, aa + p * p, bb + q * q
        return max(-1.0, min(1.0, dot / math.sqrt(aa * bb)))

    want = {}
    for a in (i for i in x if i % 10 == 0):
        best = heapq.nsmallest(5, ((-cosine(x[a], v), i) for i, v in x.items() if i != a and len(v) == len(x[a])))
        want |= {(a, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-12 for k in want)


def test_tiles_of_many_components_are_exact_and_within_their_bounds():
    rng = np.random.default_rng(1)
    a, b = nearest.Tile(rng.normal(size=(20, 2500)) ** 3, np.arange(20)), nearest.Tile(rng.normal(size=(30, 2500)), np.arange(30))
    p = nearest.products(a.code, b.code)
    assert (p == a.code.astype("i8") @ b.code.astype("i8").T).all()
    near = p * a.step[:, None] * b.step[None, :]
    true = (a.v @ b.v.T) / np.sqrt(a.sq[:, None] * b.sq[None, :])
    assert (np.abs(true - near) <= a.rest[:, None] * b.size[None, :] + b.rest[None, :] + nearest.ROUND).all()


def test_empty_vectors(spark):
    empty = table(spark, []).limit(0)
    assert hard_negatives.hard_negatives(empty, F.col("id") % 2 == 0).collect() == []
    assert nearest.nearest(empty, F.col("id") % 2 == 0).collect() == []
    one = table(spark, [(0, [1.0, 2.0], 1), (1, None, 1)])
    assert nearest.nearest(one, F.col("id") % 2 == 0).collect() == [] and hard_negatives.hard_negatives(one, F.col("id") % 2 == 0).collect() == []


def brute_collocations(docs, max_n, least, top):
    f, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(l2 == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (l2, q), b in cand.items()):
            continue
        s, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return {(lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("max_n,least,top", [(4, 3, 2000), (2, 2, 7), (3, 1, 40)])
def test_collocations(spark, max_n, least, top, monkeypatch):
    rng = random.Random(max_n)
    words = ["the", "The", "é", "É", "a", "b's", "New", "york", " ", "x\x00y", "zwölf"]
    docs = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\t", "\n", "!"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None])) for _ in range(40)]
    docs += [("new york city hall " * 30, "en"), ("a a a a a a", "en"), (None, "en"), ("", None), (" \t", "fr"), ("one", "es"), ("...;;", "es"), ("new york", "und")] + [("same text here", "fr")] * 5
    df = spark.createDataFrame([(i, t, lang, "s", 1, "p", 2, 3) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, phrase string, n int, f string, rank int, score int").repartition(4)
    monkeypatch.setattr(collocations, "PHRASES", 5)
    got = collocations.collocations(df, max_n, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_collocations(docs, max_n, least, top) and rows
    assert collocations.collocations(df.limit(0), max_n, least, top).collect() == []


def test_a_full_bitmap_only_costs_time(spark, monkeypatch):
    """Where every bit is set nothing is left out beforehand, and the result is the same."""
    docs = [("red green blue red green", "en")] * 4 + [("one two three four", "en")]
    df = spark.createDataFrame([(t, lang) for t, lang in docs], "text string, lang string")
    monkeypatch.setattr(collocations, "frequent_bits", lambda grams: b"\xff" * 64)
    assert {tuple(r) for r in collocations.collocations(df, 4, 4).collect()} == brute_collocations(docs, 4, 4, 2000)
