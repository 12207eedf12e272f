"""What attribute strings cost to parse, and long ones."""

from pyspark.sql import functions as F

from strandloom.functions import attributes as A


def test_attributes_are_split_once(spark):
    x = spark.createDataFrame([("ID=a;b=c",)], "a string").select(A.parse_quoted(F.col("a")).alias("m"))
    assert x._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1


def test_long_values(spark):
    long = "x y" * 30_000
    texts = [f"ID=a;note={long}", f'gene_id "{long};"; n "', 'a "b;c', ";;", 'k=","', 'k=a,,b;k="c,d";flag;v=%2C+%zz']
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "a string").select(A.parse_quoted(F.col("a")).alias("m")).collect()]
    want = [{"ID": ["a"], "note": [long]}, {"gene_id": [f"{long};"], "n": ['"']}, {"a": ['"b'], "c": ["true"]}, {}, {"k": [","]}, {"k": ["a", "b", "c,d"], "flag": ["true"], "v": ["%2C+%zz"]}]
    assert got == want  # codes that are not valid stay
