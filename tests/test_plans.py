"""What plans must not hold, whatever the size of the tables that they are made for."""

from pyspark.sql import functions as F

from strandloom.plans import fixtures
from strandloom.sources import fasta


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bases_are_not_broadcast(spark):
    seq = spark.createDataFrame([("c", "ACGT" * 100)], "seq string, dna string")
    at = spark.range(0, 390).select(F.lit("c").alias("seq"), F.col("id").alias("at"))
    found = fasta.bases_at(at, fasta.blocks(seq, 64, 1), {"b": F.col("at")}, 2, 64)
    plan = executed(found)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {r.at: r.b for r in found.collect()} == {k: ("ACGT" * 100)[k : k + 2] for k in range(390)}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_features_come_from_one_shuffle(spark):
    sf = "/root/testdata/sf0.001"
    assert exchanges(fixtures.view(spark, sf, "feature")) == 1
    assert exchanges(fixtures.view(spark, sf, "wide").drop("sequence_length")) <= 2  # the other one is for the lengths of sequences
