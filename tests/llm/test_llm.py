"""Operators for training data: brute force on small fixtures, round trips, held-out accuracy and the cases of each docstring."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from strandloom.llm import bpe, components, exact_dedup, jpeg_media, language_id, license_scan, mixing, ngram_join, quality, queries, shingles, substring_dedup, token_counts

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, label string, copies string, _row string"
BASE = " ".join(f"word{i}" for i in range(80))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "k", "n", "l", "c", "r") for i, t, lang, src in rows], DDL)


ROWS = [
    (1, BASE, "en", "src1"), (2, BASE.replace("word40 ", "other "), "en", "src1"), (3, BASE, None, None), (4, None, "en", "src2"), (5, "", "de", None), (6, "one two", "de", "src1"),
    (7, "ONE  two", "de", "src1"), (None, BASE, "en", "src1"), (8, "x" * 5000 + " " + "7" * 3000 + " \n\n  end", "fr", "src3"), (9, BASE.upper(), "fr", "src3"), (9, BASE.upper(), "fr", "src3"),
    (10, "É été à l'œuvre. " * 300, "fr", "src4"), (11, " \t\n ", "es", "src4"), (12, "Released under the MIT License. " + BASE[:300], "es", "src4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_against_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLE[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        at = [want.columns.index(c) for c in cols]
        text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        assert sorted(tuple(text(r[c]) for c in cols) for r in got) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


# 1


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (64, 16), (30, 8)])
def test_bpe_equals_whole_text_encoding(spark, docs, chunk, overlap):
    core = bpe.codec(RANKS, P.PATTERN).core
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs, RANKS, P.PATTERN, chunk, overlap).collect())
    want = []
    for i, t, *_ in ROWS:
        ids = core.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_bpe_ids_and_decoding(spark, docs, empty):
    ids = bpe.encode_ids(docs.where("doc_id = 10"), RANKS, P.PATTERN)
    assert bytes(bpe.decode_ids(ids, RANKS, P.PATTERN).first().decoded).decode() == ROWS[11][1]
    assert bpe.bpe_digests(empty, RANKS, P.PATTERN).count() == 0


# 2


def brute_components(rows, words, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if x]
        sets.setdefault(i, set()).update(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)) if w)
    ids, label = [i for i in sets if i is not None], {}
    for i in ids:
        label[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_join_against_all_pairs(spark, docs, empty):
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect() if r.doc_id is not None}
    assert got == brute_components(ROWS, 4, 85, 100)
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("words, num", [(1, 60), (4, 85), (5, 80)])
def test_join_on_random_near_copies(spark, words, num):
    rng = np.random.default_rng(words)
    rows, bases = [], [rng.integers(0, 400, int(n)).tolist() for n in rng.integers(1, 160, 12)]
    for i in range(120):
        w = list(bases[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = int(rng.integers(0, 400))
        rows.append((i, " ".join(f"w{x}" for x in w), "en", "s"))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(make(spark, rows), words, num, 100).collect()}
    assert got == brute_components(rows, words, num, 100)


def test_join_of_a_frequent_list_of_three_with_an_oversize_centre(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "slot_ranks", lambda first, total: FREQUENT)
    near, more = [f"u{i}" for i in range(300)], [f"v{i}" for i in range(200)]
    texts = [" ".join(near + more), " ".join([*near, "one"]), " ".join([*near, "two"])]
    sets = [ngram_join.shingle_set(t, 4) for t in texts]
    slots = lambda s: (s >> np.uint64(64 - ngram_join.SLOT_BITS)).astype(np.int64)
    FREQUENT = np.zeros(1 << ngram_join.SLOT_BITS, np.uint8)
    FREQUENT[slots(sets[0])] = 2  # all of the large text is frequent and makes it the centre; the others have a rare shingle each
    rows = [(i + 1, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(make(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85, 100) == {1: 1, 2: 2, 3: 2}


def test_join_on_frequent_lists_of_copied_nodes(spark):
    """Lines that most texts share make lists frequent; large and small texts around them are centres of lists that cannot link."""
    rng = np.random.default_rng(21)
    lines = [[f"l{k}w{i}" for i in range(40)] for k in range(3)]
    rows = []
    for i in range(90):
        w = [x for k in rng.permutation(3)[: int(rng.integers(1, 4))] for x in lines[k]] + [f"o{int(rng.integers(0, 30))}" for _ in range(int(rng.integers(0, 5)))]
        w += w[: int(rng.integers(0, 4))] * int(rng.integers(0, 20))
        rows += [(len(rows) + c, " ".join(w), "en", "s") for c in range(int(rng.choice([1, 1, 4])))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(make(spark, rows)).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_join_tells_sets_with_one_key_apart(spark, monkeypatch):
    keys = ngram_join.set_keys
    monkeypatch.setattr(ngram_join, "set_keys", lambda s: (7, keys(s)[1]))
    rows = [(1, "a b c d e f", "en", "s"), (2, "u v w x y z", "en", "s"), (3, "A b c d e f", "en", "s")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in ngram_join.jaccard_components(make(spark, rows)).collect()}
    assert got == {1: (1, 3), 2: (2, 3), 3: (1, 3)}


def test_signature_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for n in (3, 200, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 5 :], rng.integers(0, 1 << 62, n // 2).astype(np.uint64)]))
        s, t = ngram_join.signature(x), ngram_join.signature(y)
        size = min(len(s), len(t))
        assert np.bitwise_count(ngram_join.fold(s, size) ^ ngram_join.fold(t, size)).sum() <= len(np.setxor1d(x, y))


def test_boundary_follows_cost():
    assert ngram_join.boundary({}) == 1
    assert ngram_join.boundary({n: 10 for n in range(6, 60)}) > 10
    assert ngram_join.boundary({200: 1000}) == 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_components_of_random_links(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-50, 150, (120, 2))] + [(1000, 1000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(7000, 7001 + i) for i in range(50)]
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_columns_and_clean_rows(spark, docs):
    out = ngram_join.keep_one(docs, 5, 80, 100)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {1, 4, 5, 8, 10, 12}
    assert 2 not in {r.doc_id for r in out.collect()}
    clash = docs.withColumn("_gone", F.col("doc_id")).withColumn("component_id", F.lit("x"))
    assert ngram_join.keep_one(clash, 5, 80, 100).columns == clash.columns


# 3


@pytest.mark.parametrize("text, labels", [
    ("Released under the terms of the Expat MIT license", ["notice-mit"]), ("released under MIT license", []), ("licensed under CC BY-NC 4.0.", ["notice-cc"]),
    ("Copyright (c) 2001 Some One. All rights reserved", ["text-rights"]), ("Copyright one two three four five six seven all rights reserved", []),
    ("This work is licensed under the GNU General Public License, version 3", ["notice-gpl"]), ("", []), (None, []),
])
def test_templates(text, labels):
    assert [x[2] for x in license_scan.Scanner().scan(text)[2]] == labels


# A license text and a header as projects print them.
MIT = """The MIT License (MIT) Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize("text, labels", [
    (MIT, ["full-mit", "text-mit"]), (MIT.replace("publish, ", ""), ["text-mit"]), (FREE.format("", 3), ["header-gpl"]), (FREE.format("Lesser ", "2.1"), ["header-lgpl"]), (FREE.format("Affero ", 3), ["header-agpl"]),
    ('This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.', ["header-mpl"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["header-cc"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ["header-apache", "notice-apache"]),
])
def test_standard_texts(text, labels):
    assert sorted(x[2] for x in license_scan.Scanner().scan("x " + text + " y")[2]) == labels


def test_templates_accept_the_wording_that_they_spell_out():
    """Each template with all and with none of its optional words; no text without its first or its last mandatory word."""
    import re

    for k, markup in license_scan.TEMPLATES.items():
        accepts = license_scan.compile_template(markup).accepts
        least = re.sub(r"<<opt>>.*?<</opt>>", "", markup)
        for wording in (markup.replace("<<opt>>", "").replace("<</opt>>", ""), least):
            for n in (0, 2):
                words = re.sub(r"<<var \d+>>", " any" * n, wording).encode().split()
                assert accepts(words, 0) == len(words), k
                assert accepts([b"other", *words[1:]], 0) == -1
        words = re.sub(r"<<var \d+>>", "", least).encode().split()
        assert accepts(words[:-1], 0) == -1


def test_automata_against_regular_expressions():
    import re

    rng = np.random.default_rng(5)
    for _ in range(300):
        parts = ["a"]
        for _ in range(int(rng.integers(1, 6))):
            w = "abc"[int(rng.integers(0, 3))]
            parts.append([w, f"<<opt>>{w}<</opt>>", f"<<var {int(rng.integers(1, 3))}>>", f"<<opt>>{w} <<opt>>c<</opt>><</opt>>"][int(rng.integers(0, 4))])
        markup = " ".join(parts)
        words = ["abc"[i] for i in rng.integers(0, 3, 8)]
        text = "".join(f" {w} " for w in words)
        pattern = queries._pattern(markup)
        for at in range(8):
            ends = [e for e in range(at, 9) if re.fullmatch(pattern, text[3 * at : 3 * e])]
            assert license_scan.compile_template(markup).accepts([w.encode() for w in words], at) == max(ends, default=-1)


def test_license_columns(spark, docs, empty):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[12].n_base, got[12].first_word, got[12].labels, got[12].score) == (1, 3, "mit,notice-mit", 1.0)
    assert got[4].n_words == 0 and got[4].labels == "" and got[4].first_word is None
    assert license_scan.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.compile_template("a <<opt>> b")


# 4


def test_ledger_is_idempotent_and_additive(spark, tmp_path):
    one = spark.createDataFrame([("a", "en", "v", 5), ("a", "en", "v", None), (None, "en", "v", 2)], "source string, lang string, version string, n_tokens long")
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", token_counts.inserts(one)) and not ledger.commit("b1", token_counts.inserts(one))
    assert ledger.commit("b2", token_counts.revisions(one.where("n_tokens = 5"), F.col("n_tokens"), F.lit(9)))
    assert {tuple(r) for r in ledger.totals().collect()} == {("a", "en", "v", 2, 9), (None, "en", "v", 1, 2)}
    assert ledger.commit("b3", token_counts.deletes(one.where("source is null"))) and ledger.commit("b4", token_counts.inserts(one.limit(0)))
    again = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert again.batches() == ["b1", "b2", "b3", "b4"] and [tuple(r) for r in again.totals().collect()] == [("a", "en", "v", 2, 9)]


def test_ledger_after_deaths_and_with_two_writers(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "v", 5, "x")], "source string, lang string, version string, n_tokens long, n_docs string")
    path = str(tmp_path / "ledger")
    ledger, put = token_counts.Ledger(spark, path), token_counts.Ledger._put
    calls = []

    def dies(at):
        def run(self, *args):
            calls.append(args[0])
            if len(calls) == at:
                raise SystemExit
            return put(self, *args)

        return run

    for at in (1, 2):  # after the data is written, and between commit and marker
        calls.clear()
        monkeypatch.setattr(token_counts.Ledger, "_put", dies(at))
        with pytest.raises(SystemExit):
            ledger.commit("b1", token_counts.inserts(rows))
        monkeypatch.setattr(token_counts.Ledger, "_put", put)
    assert not ledger.commit("b1", token_counts.inserts(rows)) and ledger.batches() == ["b1"]
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 1, 5)]
    other = token_counts.Ledger(spark, path)
    monkeypatch.setattr(token_counts.Ledger, "_totals", lambda self, last, f=token_counts.Ledger._totals: (self is ledger and other.commit("b2", token_counts.inserts(rows)), f(self, last))[1])
    with pytest.raises(RuntimeError, match="another writer"):
        ledger.commit("b3", token_counts.inserts(rows))
    monkeypatch.undo()
    assert ledger.commit("b3", token_counts.inserts(rows)) and ledger.batches() == ["b1", "b2", "b3"]
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 3, 15)]


def test_counts_by_vocabularies(spark, docs, empty):
    files = {"n": P.path("byte_bpe_50k.tiktoken"), "m": RANKS}
    got = token_counts.count_tokens(docs, files, P.PATTERN)
    assert got.columns == [c for c in docs.columns if c not in ("text", "n")] + ["n", "m"]
    for k, f in files.items():
        core = bpe.codec(f, P.PATTERN).core
        want = sorted((r.doc_id or 0, len(core.encode_ordinary(r.text or ""))) for r in docs.collect())
        assert sorted((r.doc_id or 0, r[k]) for r in got.collect()) == want
    assert token_counts.count_tokens(empty, files, P.PATTERN).count() == 0


def test_token_count_query_by_hand(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    one, two = (bpe.codec(f, P.PATTERN).core for f in (P.path("byte_bpe_50k.tiktoken"), RANKS))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        a, b = len(one.encode_ordinary(r.text or "")), len(two.encode_ordinary(r.text or ""))
        for version, n in (("byte_bpe_50k", a), *([("current", b)] if a >= 10 else [])):
            for level, s, g in (("source,lang", r.source, r.lang), ("source", r.source, None), ("lang", None, r.lang), ("", None, None)):
                x = want.setdefault((version, level, s, g), [0, 0])
                x[0] += 1
                x[1] += n
    assert {(r.version, r.level, r.source, r.lang): [r.n_docs, r.n_tokens] for r in queries.op4_token_counts(spark, SF).collect()} == want


# 5


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: " ".join(("x" + (t or "") + "x").split())[1:-1] if (t or "").strip() else (" " if t else "")
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    for r in got:
        g = next(v for v in groups.values() if r.doc_id in v and len(v) == r.group_size)
        assert r.keep_id == min(x for x in g if x is not None)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0


# 6


def test_compact_windows_cover_each_stretch_once():
    rng = np.random.default_rng(1)
    for k in range(60):
        m, w = int(rng.integers(1, 40)), int(rng.integers(1, 12))
        v = rng.integers(0, 12 if k % 2 else 10**9, m).astype(np.uint64)
        got = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(v, w))))
        for i in range(m):
            for j in range(i + w - 1, m):
                hits = [c for a, c, b in got if a <= i <= c <= j <= b]
                assert len(hits) == 1 and v[hits[0]] == v[i : j + 1].min()


def test_substring_dedup_finds_planted_passages(spark, empty):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    shared, near = text(60), text(100).split()
    other = [w if i % 25 else "changed" for i, w in enumerate(near)]
    rows = [(1, f"{text(90)} {shared} {text(40)}"), (2, f"{text(10)} {shared.upper()}"), (3, text(300)), (4, " ".join(near)), (5, f"{text(70)} {' '.join(other)}"), (6, text(20)), (7, f"{shared} {text(5)}")]
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows] + [(None, shared, None, None), (8, None, None, None), (9, "", None, None)])).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, 5, 7}
    hit = next(r for r in got if r.doc_id == 1)
    assert (hit.first_word, hit.last_word, hit.similarity) == (90, 149, 1.0)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_passage_around_a_frequent_line(spark, seed):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    line = text(45)
    both = [f"{text(8)} {line} {text(7)}" for _ in range(6)]
    rows = [(i, f"{text(60)} {line} {text(60)}") for i in range(40)] + [(100 + i, f"{text(60)} {both[i // 2]} {text(60)}") for i in range(12)]
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows]), enough=1, hashes=2).collect()
    assert {(r.doc_id, r.first_word, r.last_word, r.other_id) for r in got} == {(100 + i, 60, 119, 100 + (i ^ 1)) for i in range(12)}


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
@pytest.mark.parametrize("others", [0, 40])
def test_substring_dedup_reports_each_place_of_a_passage(spark, ids, others):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    shared = text(60)
    rows = [(ids[0], f"{text(30)} {shared} {text(30)}"), (ids[1], f"{shared} {text(200)} {shared} {text(20)}")]
    rows += [(10 + i, f"{text(20)} {shared} {text(20)}") for i in range(others)]
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    found = {(r.first_word, r.last_word) for r in got if r.doc_id == ids[1]}
    assert found >= {(0, 59), (260, 319)} and all(0 <= a < b <= 59 or 260 <= a < b <= 319 for a, b in found)


def test_substring_dedup_recall_at_the_accepted_share(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for k in range(300):
        near = words(54)  # 50 shingles, of which two changed words leave 40: a share of 80 %
        other = [w if i not in (17, 36) else "changed" for i, w in enumerate(near)]
        rows += [(2 * k, " ".join(words(30) + near + words(30))), (2 * k + 1, " ".join(words(20) + other + words(40)))]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    found = sum((2 * k, 2 * k + 1) in got for k in range(300))
    assert found >= 297 and all(a ^ 1 == b for a, b in got)


def test_passages_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(9)
    for share in ((8, 10), (1, 2), (1, 1)):
        xs, ys = [], []
        for k in range(150):
            x = rng.integers(0, 1 << 32, int(rng.integers(0, 60)), dtype=np.uint32)
            y = np.concatenate([rng.integers(0, 1 << 32, int(rng.integers(0, 9)), dtype=np.uint32), x[int(rng.integers(0, 5)) :]])
            y[rng.random(len(y)) < rng.choice([0, 0.05, 0.2, 0.6])] = 7
            xs.append(x)
            ys.append(np.concatenate([y, y]) if k % 5 == 0 else y)
        want = [(k, p) for k in range(150) for p in substring_dedup.passages(xs[k], ys[k], 10, share)]
        got = substring_dedup.all_passages(xs, ys, 10, share)
        assert [(k, p[:4]) for k, p in got] == [(k, p[:4]) for k, p in want] and np.allclose([p[4] for _, p in got], [p[4] for _, p in want])
        sizes = np.array([len(x) for x in xs])
        hits = [np.isin(x, y) for x, y in zip(xs, ys)]
        got = substring_dedup.longest(np.concatenate(hits), sizes, np.cumsum(sizes) - sizes, share)
        assert got.tolist() == [max((e - s for s, e in substring_dedup.stretches(h, share, 1)), default=0) for h in hits]


def test_windows_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(10)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 300, n)).encode() for n in (0, 3, 70, 200, 49, 50, 120)]
    value, whole, text, l, c, r = substring_dedup.text_windows(texts, 5, 46, 3)
    for i, t in enumerate(texts):
        one = substring_dedup.text_windows([t], 5, 46, 3)
        assert [x[text == i].tolist() for x in (value, whole, l, c, r)] == [one[k].tolist() for k in (0, 1, 3, 4, 5)]
        assert (len(one[0]) > 0) == (len(t.split()) >= 50)


def brute_stretches(rows, words=50):
    """Pairs of documents with an equal stretch of that many words."""
    at = {}
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if x]
        for k in range(len(w) - words + 1):
            at.setdefault(" ".join(w[k : k + words]), set()).add(i)
    return [s for s in at.values() if len(s) > 1]


def test_substring_dedup_against_brute_force(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = substring_dedup.substring_dedup(docs).collect()
    groups = brute_stretches([(r.doc_id, r.text) for r in docs.collect()])
    direct = {(r.doc_id, r.other_id) for r in got}
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add((r.class_doc, r.class_word))
    pairs = {(a, b) for g in groups for a in g for b in g if a < b}
    assert pairs and all(classes[a] & classes[b] for a, b in pairs)
    small = {(a, b) for g in groups if len(g) <= 4 for a in g for b in g if a < b}
    assert len(small & direct) >= 0.9 * len(small)


def test_substring_dedup_classes_and_hubs(spark):
    """Forty documents share a passage in other surroundings, and twelve are near copies of another one: each is one class."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    shared, near = words(55), words(120)
    rows = [(i, " ".join(words(20) + shared + words(20))) for i in range(40)]
    for i in range(12):
        w = list(near)
        for k in rng.integers(0, 120, 3):
            w[k] = f"x{i}"
        rows.append((100 + i, " ".join(words(30) + w + words(30))))
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {(r.doc_id, r.class_doc, r.class_word) for r in got} == {(i, 0, 20) for i in range(40)} | {(100 + i, 100, min(r.first_word for r in got if r.doc_id == 100)) for i in range(12)}
    near_pairs = {(r.doc_id, r.other_id) for r in got if r.doc_id >= 100}
    assert len(near_pairs) == 12 * 11


def brute_classes(rows, got):
    """Pairs of documents with a common passage, by comparing all of both texts; and each document's classes in got."""
    seq = {i: (shingles.shingle_hashes(shingles.word_hashes(t), 5) >> np.uint64(32)).astype(np.uint32) for i, t in rows}
    classes = {}
    for r in got:
        classes.setdefault(r.doc_id, set()).add((r.class_doc, r.class_word))
    return {(a, b) for a in seq for b in seq if a < b and substring_dedup.passages(seq[a], seq[b], 46, (8, 10))}, classes


@pytest.mark.parametrize("seed,carriers", [(1, 40), (1, 0), (3, 40)])
def test_substring_dedup_near_copies_around_a_frequent_line(spark, seed, carriers):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    line = words(45)
    rows = [(10_000 + i, " ".join(words(60) + line + words(60))) for i in range(carriers)]
    for k in range(200):
        one = words(8) + line + words(7)
        two = [w if i not in (6, 54) else "changed" for i, w in enumerate(one)]
        rows += [(2 * k, " ".join(words(60) + one + words(60))), (2 * k + 1, " ".join(words(60) + two + words(60)))]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == {(i, i ^ 1) for i in range(400)}


@pytest.mark.parametrize("block", [512, 8])
def test_substring_dedup_frequent_passages_beside_their_hub(spark, monkeypatch, block):
    """Lines that many documents have, alone and in passages that share nothing rare; the smallest document has one line only."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "SLICE", block << 10)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    one, two, three = words(30), words(30), words(30)
    parts = [one, two, three, one + words(1) + two, three + one, one + three + two[:9]]
    rows = [(0, " ".join(words(40) + one + words(40)))]
    for i in range(1, 151):
        kind = parts[i % 6]
        if i % 6 == 3:
            kind = one + words(1) + two  # five shingles of each are its own
            kind[int(rng.integers(3, 27))] = "x"
        rows.append((i, " ".join(words(20) + kind + words(20))))
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    pairs, classes = brute_classes(rows, got)
    assert len(pairs) > 500 and all(classes.get(a, set()) & classes.get(b, set()) for a, b in pairs)
    assert set(classes) == {i for p in pairs for i in p}


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_near_copies_with_frequent_lines_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    lines = [words(int(n)) for n in (20, 35, 45, 48)]
    base = [words(30) + lines[k % 4] + words(20) for k in range(5)]
    rows = []
    for i in range(160):
        w = words(30) + lines[int(rng.integers(4))] + words(15)
        if i % 2:
            near = list(base[int(rng.integers(5))][int(rng.integers(0, 25)) :])
            for k in rng.integers(0, len(near), int(rng.integers(0, 4))):
                near[k] = f"x{i}"
            w += near
        rows.append((int(i * 7 % 160), " ".join(w + words(10))))
    got = substring_dedup.substring_dedup(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    pairs, classes = brute_classes(rows, got)
    lost = [p for p in pairs if not classes.get(p[0], set()) & classes.get(p[1], set())]
    assert len(pairs) > 300 and len(lost) <= len(pairs) // 100


def test_passage_parts_are_all_stretches_that_may_be_passages():
    rng = np.random.default_rng(12)
    for k in range(300):
        doc, at, want, width = [], [], [], (5, 8, 12)[k % 3]
        for d in range(int(rng.integers(1, 4))):
            hit = rng.random(int(rng.integers(1, 60))) < rng.choice([0.3, 0.6, 0.8, 0.9])
            hit[0] = True
            p = np.flatnonzero(hit).tolist()
            found: list[list[int]] = []
            for i, j in ((i, j) for i in p for j in p if j - i + 1 >= width and hit[i : j + 1].mean() >= 0.8):
                if found and i <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], j)
                else:
                    found.append([i, j])
            want += [(d, i, j) for i, j in found]
            doc += [d] * len(p)
            at += p
        doc, at = np.array(doc), np.array(at)
        first, last = substring_dedup.passage_parts(doc, at, width, (8, 10))
        assert list(zip(doc[first].tolist(), at[first].tolist(), at[last].tolist())) == want


def test_link_lists_of_any_length(spark):
    """Places of a list of up to 16 are linked in all pairs; those of longer ones, over many batches too, all come as rows."""
    size = {k: n for k, n in enumerate((1, 2, 16, 17, 40_000, 3))}
    rows = [(k, 1000 * k + i, 100 << 24 | 50 << 12 | 60) for k, n in size.items() for i in range(n)]
    places = spark.createDataFrame(rows, substring_dedup.PLACE_DDL)
    got = substring_dedup.link_lists(places, 46).collect()
    often = [(r.key, r.a, r.s) for r in got if r.key is not None]
    assert sorted(often) == sorted((k, d, 100) for k, d, _ in rows if size[k] > 16)
    pairs = {(r.a, r.b, r.s, r.e, r.shift) for r in got if r.key is None}
    assert pairs == {(1000 * k + i, 1000 * k + j, 50, 161, 0) for k, n in size.items() if n <= 16 for i in range(n) for j in range(i + 1, n)}
    assert substring_dedup.link_lists(places, 112).where("key is null").count() == 0


# 7


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "a", 10), ("d1", "b", 100), ("d2", "c", 100)], "domain string, lang string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang"], (100, 210), {}, 1).collect()}
    assert got == {("d1", "a"): 10, ("d1", "b"): 40, ("d2", "c"): 50}
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ["domain", "lang"], (180, 210), {"domain": {"d1": 9}}, 1).collect()}
    assert got == {("d1", "a"): 10, ("d1", "b"): 100, ("d2", "c"): 70}


def test_mix_stays_within_budgets(spark, docs, empty):
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    got = mixing.mix(docs, levels).collect()
    assert len(got) == len(ROWS)
    used = {}
    for r in got:
        used[r.domain, r.lang, r.source] = used.get((r.domain, r.lang, r.source), 0) + r.copies * r.n_tokens
    assert all(used[r.domain, r.lang, r.source] <= r.budget for r in got)
    assert mixing.mix(empty, levels).count() == 0 and mixing.take(docs, levels).columns == docs.columns


# 8


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.round(rng.normal(size=500), 1))], "doc_id long, key double")
    for k in (0, 1, 123, 500):
        kept = [r for r in quality.top_k(rows, k).collect() if r.kept]
        want = sorted(rows.collect(), key=lambda r: (-r.key, r.doc_id))[:k]
        assert {r.doc_id for r in kept} == {r.doc_id for r in want}


def test_resampling_prefers_the_target(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.importance_resample(docs, labels).collect()}
    assert got[1].log_weight > got[10].log_weight and got[4].log_weight == 0.0
    assert quality.importance_resample(empty, labels).count() == 0


def test_weights_and_draws_by_hand(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    texts = [(i, t) for i, t, *_ in ROWS]
    raw, target = (np.bincount(np.concatenate([quality.grams(t) for i, t in own]), minlength=quality.BUCKETS) for own in (texts, [x for x in texts if x[0] in (1, 2)]))
    p, q = (target + 1) / (target.sum() + quality.BUCKETS), (raw + 1) / (raw.sum() + quality.BUCKETS)
    want = {(i or 0, round(float(sum(np.log(p[g] / q[g]) for g in quality.grams(t))), 6)) for i, t in texts}
    got = quality.importance_resample(docs, labels).collect()
    assert {(r.doc_id or 0, round(r.log_weight, 6)) for r in got} == want
    assert sum(r.kept for r in got) == len(ROWS) * 4 // 5
    assert min(r.key for r in got if r.kept) >= max(r.key for r in got if not r.kept)
    mean = quality.importance_resample(docs, labels, per_gram=True).where("doc_id = 1").first().log_weight
    assert mean == pytest.approx(next(w for i, w in want if i == 1) / len(quality.grams(BASE)), abs=1e-6)


def test_top_k_with_many_ties(spark):
    rows = spark.createDataFrame([(i % 7, 1.0) for i in range(300)] + [(None, 1.0), (9, 2.0)], "doc_id long, key double")
    kept = [r.doc_id for r in quality.top_k(rows, 60).collect() if r.kept]
    assert len(kept) == 60 and 9 in kept and None in kept and set(kept) == {None, 9, 0, 1}


# 9


def test_jpeg_round_trip():
    rng = np.random.default_rng(4)
    for n in (64, 128, 64 * 300):
        for p in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), b"\xff" * n, bytes(n)):
            assert b"".join(x[2].tobytes() for x in jpeg_media.decode(jpeg_media.encode(p))) == p
    with pytest.raises(ValueError):
        jpeg_media.encode(b"abc")


def test_jpeg_of_three_components_without_restarts():
    """Two 16x16 units, luminance sampled 2x2: DC differences of all blocks by hand; the thumbnail is four samples by two."""
    bits = ""
    table = {s: f"{c:0{n}b}" for n, c, s in jpeg_media.canonical(jpeg_media.DC_COUNTS, range(12))}
    code = lambda d: table[abs(d).bit_length()] + ("" if d == 0 else f"{d if d > 0 else d + (1 << abs(d).bit_length()) - 1:0{abs(d).bit_length()}b}") + "0"
    for luma in ([10, -3, 0, 7], [1, 1, 1, 1]):
        bits += "".join(map(code, luma)) + code(5) + code(-6)
    bits += "1" * (-len(bits) % 8)
    body = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg_media.segment
    head = seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 8] + [1] * 63)) + seg(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0, *jpeg_media.DC_COUNTS, *range(12), 0x10, *jpeg_media.AC_COUNTS, 0])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    (w, h, thumb), = jpeg_media.decode(b"\xff\xd8" + head + body + b"\xff\xd9")
    assert (w, h) == (32, 16)
    assert thumb.tolist() == [[138, 135, 143, 144], [135, 142, 145, 146]]


def test_media_columns(spark, docs, empty):
    got = {r.doc_id: r for r in jpeg_media.media_features(jpeg_media.to_media(docs)).collect()}
    for i, t, *_ in ROWS:
        p = (t or "").encode()
        p += bytes(-len(p) % 64 if p else 64)
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-64:])
    assert got[1].media_sha256 == got[3].media_sha256 and got[4].n_bytes == 0 and got[4].payload_bytes == 64
    assert jpeg_media.media_features(jpeg_media.to_media(empty)).count() == 0


# 10


def test_language_accuracy_held_out(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs, empty):
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert got[4].lang_pred == got[5].lang_pred == got[11].lang_pred == "und" and got[4].score == 0
    assert got[8].held_out == (zlib.crc32(b"8") % 4 == 2)
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.keep_known(docs).columns == docs.columns


def test_language_trains_every_language(spark, monkeypatch):
    rows = [(3 * i + k, f"text {i} {k}", f"l{i:02}", "s") for i in range(80) for k in range(3)] + [(1000, "...", "none", "s")]
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 100)
    got = [r.lang for r in language_id.training_rows(make(spark, rows), F.lit(True), 2).collect()]
    assert sorted(got) == [f"l{i:02}" for i in range(80)]


def test_language_machines_for_a_hundred_languages():
    rng = np.random.default_rng(6)
    x = rng.random((200, language_id.DIM), np.float32)
    x[np.arange(200), np.arange(200) // 2 * 7] += 60
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    langs = np.array([f"l{i // 2:03}" for i in range(200)], dtype=object)
    found, score = language_id.Model(x, langs).predict(x.astype(np.float64))
    assert found == langs.tolist() and (score > 0.5).all()


def test_language_filter_uses_the_prediction(spark):
    """Two languages by their letters: mislabelled and unlabelled rows get the predicted language, texts of other letters go; without
    any label all rows with a letter stay as they are."""
    rng = np.random.default_rng(7)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(60))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz"), "aa" if i % 2 else "uu", "s") for i in range(900)]
    wrong = next(i for i in range(1001, 1500) if zlib.crc32(str(i).encode()) % 4 == 2)  # not trained on
    rows += [(wrong, text("abcdef"), "uu", "s"), (1503, text("abcdef"), None, "s"), (2000, "0 1 2", "aa", "s"), (2001, None, "aa", "s")]
    docs = make(spark, rows)
    got = {r.doc_id: r.lang for r in language_id.keep_known(docs).collect()}
    assert got == {i: "aa" if i % 2 or i == wrong else "uu" for i, *_ in rows if i < 2000}
    model, bound = language_id.fit(docs, F.lit(True), calibrate=language_id.CALIBRATE)
    assert 0.25 < bound < 0.5
    odd = make(spark, [(1, "q", None, "s")])
    assert language_id.keep_predicted(odd, model, 0.9).count() == 0
    bare = language_id.keep_known(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.doc_id for r in bare} == {i for i, *_ in rows if i < 2000} and {r.lang for r in bare} == {None}


# the pipeline


def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline as C

    make(spark, ROWS + [(20 + i, " ".join(f"z{i}w{k}" for k in range(30 + i)), "en", f"src{i}") for i in range(12)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for _, stage in C.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        assert seen[-1].columns == docs.columns
    ids = [sorted((r.doc_id or 0) for r in x.collect()) for x in seen]
    assert not {4, 5, 11} & set(ids[1]) and set(range(20, 32)) <= set(ids[1])
    assert ids[2].count(1) == 1 and 3 not in ids[2] and ids[2].count(9) == 1 and set(range(20, 32)) <= set(ids[2])
    assert 1 in ids[3] and 2 not in ids[3] and 9 not in ids[3] and set(range(20, 32)) <= set(ids[3])
    final = C.run(spark, str(tmp_path))
    assert sorted((r.doc_id or 0) for r in final.collect()) == ids[4]


def test_shingles_of_short_texts():
    assert len(shingles.shingle_set("", 4)) == 0 and len(shingles.shingle_set("a b", 4)) == 1
    assert (shingles.shingle_set("A b", 4) == shingles.shingle_set("a\t\nB", 4)).all()
    assert len(np.unique(np.concatenate([shingles.word_hashes("x" * n) for n in (1, 2, 4095, 4096, 4097, 9000)]))) == 6
