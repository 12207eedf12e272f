"""Shared helpers: the shared work folder, written intermediate tables, Arrow batch bounds and ASCII word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts, as a Java regex class.
WS = r"[\x20\x09-\x0D]+"
#: Spark then deletes the shuffle files of a plan when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="strandloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a reader of it: cuts lineage and survives lost executors.

    narrow: for tables that are small beside the texts; they get four files for each core of the cluster at most. The shuffle
    files of the plan are deleted once the table is there."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/strandloom/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def release(*dfs: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that no later plan reads."""
    for df in dfs:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession, rows: int = 8192, size: str = "4m") -> None:
    """Bounds the rows and the bytes of an Arrow batch, so that batches of long texts fit a Python worker.

    This is a setting of the session that later queries see too: plans are lazy, so it can't be put back before they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ws_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null or blank text has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WS}|{WS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def count_ws_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, without building them: starts of words are counted."""
    return F.size(ws_words(text)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
