"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing and byte-level BPE over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the next
stage. All but the last return the columns of documents. The near-duplicate stage takes five-word shingles and a similarity of
0.8. The first stage rejects rows with null or letterless texts and rows whose language is uncertain, and gives the others the
predicted language, which the mixing stage then divides by; an empty table passes through as an empty one. Each stage's table is
deleted once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from strandloom.llm._common import documents, materialize, release
from strandloom.llm.queries import MIX_WEIGHTS, RANKS


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a calibrated score; lang becomes the predicted one."""
    return language_id.keep_known(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, divided by the weights of domains and languages."""
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.take(docs, levels, share=(4, 5), weights=MIX_WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.bpe_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("bpe", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), name)
        if k:
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
