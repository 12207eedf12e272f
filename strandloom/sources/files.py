"""Input files by list, folder or pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def discover(spark: SparkSession, inputs: str | list[str], suffixes: tuple[str, ...] = ("",)) -> list[str]:
    """Paths of a comma-separated list of files, folders (searched to any depth) and patterns, each once and sorted. From folders and
    patterns only files with one of the suffixes are taken, compressed (.gz) or not. A named file that is missing is looked for with
    .gz added or taken away. An entry without a file raises."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    wanted = tuple(s + z for s in suffixes for z in ("", ".gz"))
    found: set[str] = set()
    for entry in [x.strip() for x in (inputs.split(",") if isinstance(inputs, str) else inputs) if x.strip()]:
        path = jvm.org.apache.hadoop.fs.Path(entry)
        fs, own = path.getFileSystem(conf), set()
        for status in fs.globStatus(path) or []:
            if not status.isDirectory():
                if not set(entry) & set("*?[{") or status.getPath().getName().endswith(wanted):
                    own.add(status.getPath().toString())
                continue
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                p = files.next().getPath()
                if p.getName().endswith(wanted) and p.getName()[0] not in "._":
                    own.add(p.toString())
        if not own:
            other = jvm.org.apache.hadoop.fs.Path(entry[:-3] if entry.endswith(".gz") else f"{entry}.gz")
            if not fs.exists(other):
                raise FileNotFoundError(f"no input at {entry}")
            own.add(fs.getFileStatus(other).getPath().toString())
        found |= own
    return sorted(found)


def numbered(df: DataFrame) -> DataFrame:
    """df, as a text or CSV reader gives it, with `row`: numbers from 0 on in the order of the files by path and of the rows in them.

    Within a split of a file rows come in order; counts of the splits before are added. The files are read once more for those, without
    their columns. There are as many counts as splits that the driver lists anyway, so they are broadcast."""
    x = df.withColumns({"_path": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    s = x.groupBy("_path", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_path", "_split").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return x.join(F.broadcast(s), ["_path", "_split"]).withColumn("row", F.col("_before") + F.col("_id") - F.col("_first")).select(*df.columns, "row")
