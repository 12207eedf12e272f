"""Thin queries over the test tables, one for each operator of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, hard_negatives, jpeg_media, language_id, license_scan, mixing, nearest, ngram_join, quality, substring_dedup, token_counts
from ._common import documents, materialize, shared_dir

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents under the versions `current` and `byte_bpe_50k` with that vocabulary's counts, deletes those with fewer
    than ten tokens from `current`, revises the other counts of `current` to those of byte_bpe_multi_50k, and sends the deletes a
    second time."""
    import uuid

    files = {"a": public_tokenizers.path("byte_bpe_50k.tiktoken"), "b": public_tokenizers.path(RANKS)}
    counts = materialize(token_counts.count_tokens(documents(spark, sf_dir).select("source", "lang", "text"), files, public_tokenizers.PATTERN), "counts")
    ledger = token_counts.Ledger(spark, f"{shared_dir(spark)}/strandloom/ledger-{uuid.uuid4().hex}")
    current, own = (counts.withColumn("version", F.lit(v)).withColumn("n_tokens", F.col("a")) for v in ("current", "byte_bpe_50k"))
    short = token_counts.deletes(current.where("a < 10"))
    ledger.commit("insert-current", token_counts.inserts(current))
    ledger.commit("delete-short", short)
    ledger.commit("revise-current", token_counts.revisions(current.where("a >= 10 and a <> b"), F.col("a"), F.col("b")))
    ledger.commit("insert-byte_bpe_50k", token_counts.inserts(own))
    ledger.commit("delete-short", short)
    return token_counts.rollup(ledger.totals()).select("version", "level", "source", "lang", "n_docs", "n_tokens")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, weights=MIX_WEIGHTS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_features(jpeg_media.to_media(documents(spark, sf_dir)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


# Weights of the mixing query.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_ngram_jaccard_join, op3_license_scan, op4_token_counts, op5_exact_dedup, op6_substring_dedup, op7_mixing, op8_quality, op9_jpeg_media, op10_language_id, op11_hard_negatives, op12_nearest, op13_collocations)}
ORACLE: dict[str, str] = {}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM l),
s AS (SELECT doc_id, unnest(sh) AS g FROM l),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.m)
SELECT n.doc_id, n.n_shingles, min(r.m) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


def _pattern(markup: str) -> str:
    """A template as a regular expression over a text in which every word has a blank of its own on either side."""
    part = {"<<opt>>": "(", "<</opt>>": ")?"}
    found = re.findall(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<]+", markup)
    return "".join(part.get(x) or (f"( [^ ]+ ){{0,{x[6:-2]}}}" if x.startswith("<<var") else f" {x} ") for x in found)


_LONG = ",\n".join(f"  {{'k': '{k}', 'n': len(regexp_extract_all(u, '{_pattern(v)}'))}}" for k, v in license_scan.TEMPLATES.items() if k.startswith(("header-", "full-")))

ORACLE["op3_license_scan"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS t, array_to_string(list_transform(ws, lambda x: ' ' || x || ' '), '') AS u,
 list_filter(range(1, len(ws)), lambda i: ws[i:i + 1] = ['mit', 'license']) AS mit,
 list_filter(range(1, len(ws)), lambda i: ws[i:i + 1] = ['apache', 'license']) AS apache,
 list_filter(range(1, len(ws)), lambda i: ws[i:i + 2] = ['general', 'public', 'license']) AS gpl FROM w),
q AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS al FROM p),
m AS (SELECT doc_id, ws, al, list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base,
 list_transform(list_filter([
  {'k': 'notice-apache', 'n': len(regexp_extract_all(t, ' licensed under the (terms of the )?apache license'))},
  {'k': 'notice-cc', 'n': len(regexp_extract_all(t, ' licensed under (a )?(the )?(creative commons )?cc by (nc )?(sa )?(nd )?4 0( |$)'))},
  {'k': 'notice-gpl', 'n': len(regexp_extract_all(t, ' this (work )?(program )?(software )?is licensed under the (terms of the )?(gnu )?general public license'))},
  {'k': 'notice-mit', 'n': len(regexp_extract_all(t, ' released under the (terms of the )?(expat )?mit license'))},
  {'k': 'text-bsd', 'n': len(regexp_extract_all(t, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'))},
  {'k': 'text-isc', 'n': len(regexp_extract_all(t, ' permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted'))},
  {'k': 'text-mit', 'n': len(regexp_extract_all(t, ' permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction'))},
  {'k': 'text-rights', 'n': len(regexp_extract_all(t, ' copyright (c )?([^ ]+ ){0,6}all rights reserved'))},
@LONG@], lambda x: x.n > 0), lambda x: x) AS tm FROM q)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(al)::BIGINT AS n_base, list_min(al) - 1 AS first_word, list_max(al) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
 array_to_string(list_sort(list_concat(base, list_transform(tm, lambda x: x.k))), ',') AS labels, (CASE WHEN len(al) > 0 THEN 0.5 ELSE 0.0 END + CASE WHEN len(tm) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score,
 coalesce(list_sum(list_transform(tm, lambda x: x.n)), 0)::BIGINT AS n_template FROM m
""".replace("@LONG@", _LONG)

ORACLE["op5_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def _mix_sql() -> str:
    weight = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if level in MIX_WEIGHTS else "1"
    sql = [f"""WITH d AS (SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len({_WORDS})::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL)"""]
    levels, before = ["domain", "lang", "source"], f"(SELECT 0 AS root, sum(tokens) * {mixing.SHARE[0]} // {mixing.SHARE[1]} AS budget FROM leaf)"
    for i, level in enumerate(levels):
        own, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i]) or "0"
        on = " AND ".join(f"c.{k} = p.{k}" for k in levels[:i]) or "true"
        sql.append(f"""c{i} AS (SELECT c.*, p.budget AS have, {weight(level)} AS w FROM (SELECT {own}, sum(tokens) * {mixing.MAX_EPOCHS} AS cap FROM leaf GROUP BY ALL) c JOIN {before} p ON {on})""")
        # the water level by trial: the share of weight that makes the smallest overflow
        sql.append(f"""o{i} AS (SELECT a.*, (SELECT coalesce(sum(b.cap), 0) FROM c{i} b WHERE {' AND '.join(f'a.{k} = b.{k}' for k in levels[:i]) or 'true'} AND (b.cap / b.w, b.{level}) < (a.cap / a.w, a.{level})) AS c0, (SELECT sum(b.w) FROM c{i} b WHERE {' AND '.join(f'a.{k} = b.{k}' for k in levels[:i]) or 'true'} AND (b.cap / b.w, b.{level}) >= (a.cap / a.w, a.{level})) AS w0 FROM c{i} a),
s{i} AS (SELECT *, bool_or(cap * w0 > greatest(have - c0, 0) * w) OVER (PARTITION BY {up} ORDER BY cap / w, {level}) AS open FROM o{i}),
b{i} AS (SELECT {own}, least(cap, CASE WHEN NOT open THEN cap ELSE greatest(have - coalesce(sum(cap) FILTER (NOT open) OVER (PARTITION BY {up}), 0), 0) * w // sum(w) FILTER (open) OVER (PARTITION BY {up}) END) AS budget FROM s{i})""")
        before = f"b{i}"
    sql.append(f"""x AS (SELECT d.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM d JOIN leaf USING (domain, lang, source) JOIN b2 USING (domain, lang, source)),
y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixing.SEED}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens RANGE UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS budget, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM y""")
    return ",\n".join(sql)


ORACLE["op7_mixing"] = _mix_sql()

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE["op11_hard_negatives"] = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5
"""

ORACLE["op12_nearest"] = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

ORACLE["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) t(n)),
f AS MATERIALIZED (SELECT lang, n, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, n, phrase HAVING n = 1 OR count(*) >= 30),
u AS MATERIALIZED (SELECT lang, phrase, n AS size, f AS a, ws, unnest(range(1, n)) AS k FROM f WHERE n > 1),
h AS MATERIALIZED (SELECT *, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2 FROM u),
c AS (SELECT h.lang, h.phrase, size, a, k, y.f AS l, z.f AS r, (2000000::HUGEINT * a // (y.f + z.f))::BIGINT AS score FROM h JOIN f y ON y.lang = h.lang AND y.phrase = p1 JOIN f z ON z.lang = h.lang AND z.phrase = p2),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, sub AS phrase, max(f) AS f FROM (SELECT lang, f, unnest(list_transform(range(1, n - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS sub FROM f, (VALUES (2), (3)) t(m) WHERE m < n) GROUP BY ALL),
k AS (SELECT s.* FROM s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.f IS NULL OR 100::HUGEINT * o.f < 80::HUGEINT * s.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, rank, phrase, a, l, r.r, t.n::BIGINT AS n, score FROM r JOIN (SELECT lang, sum(f) AS n FROM f WHERE n = 1 GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000
"""
