"""Work tables for iterative operators: written to the shared folder, so lost executors cost no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(value: Column, ok: Column, message: str | Column) -> Column:
    """value, or an error with that message when a row is read for which ok is not true."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, value).otherwise(F.raise_error(text))


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in such a folder."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
