"""Training datasets of labels and tokens: arrays in blocks of positions, joins that must be complete, shards and sample readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import contiguous
from .tables import checked

BLOCK = 1 << 16


def pack(df: DataFrame, keys: list[str], value: str, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """(keys, block, value): the values of each block of positions as an array in order of position."""
    x = df.select(*keys, F.floor(F.col(pos) / F.lit(block)).cast("long").alias("block"), F.struct(F.col(pos).alias("_p"), F.col(value).alias("_v")).alias("_x"))
    return x.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("_x"))["_v"].alias(value))  # one block


def block_tags(df: DataFrame, keys: list[str], label: str = "label", forward: bool = True, name: str = "tag") -> DataFrame:
    """Blocks (keys, block, label) with BILUO tags: 1 + 4 * (class - 1) + (0 begin, 1 inside, 2 last, 3 unit); labels below 1 pass through.

    A block's halo is one label of the block on either side, from a table of first and last labels."""
    ends = df.select(*keys, "block", F.get(label, F.lit(0)).alias("_first"), F.element_at(label, -1).alias("_last"))
    step = lambda d, c, n: ends.select(*keys, (F.col("block") + d).alias("block"), F.col(c).alias(n))
    x = df.join(step(1, "_last", "_left"), [*keys, "block"], "left").join(step(-1, "_first", "_right"), [*keys, "block"], "left")
    n = F.size(label)

    def tag(v, i):
        left = F.when(i == 0, F.col("_left")).otherwise(F.get(label, i - 1))
        right = F.when(i == n - 1, F.col("_right")).otherwise(F.get(label, i + 1))
        before, after = (F.coalesce(o == v, F.lit(False)) for o in ((left, right) if forward else (right, left)))
        kind = F.when(before & after, 1).when(before, 2).when(after, 0).otherwise(3)
        return F.when(v < 1, v).otherwise(1 + 4 * (v - 1) + kind).cast("int")

    return x.select(*df.columns, F.transform(label, tag).alias(name))


def label_tokens(labels: DataFrame, tokens: DataFrame, keys: list[str], label: str = "label", token: str = "token", forward: bool = True) -> DataFrame:
    """(keys, block, label, tag, token): a left join of label blocks with token blocks of the same width.

    Tokens beyond a sequence's last label are dropped; labels without a token raise."""
    x = block_tags(labels.select(*keys, "block", label), keys, label, forward).join(tokens.select(*keys, "block", token), [*keys, "block"], "left")
    enough = F.coalesce(F.size(token) >= F.size(label), F.lit(False))
    return x.withColumn(token, checked(F.slice(token, F.lit(1), F.greatest(F.size(label), F.lit(1))), enough, "more labels than tokens"))


def exact_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables that must have the same keys: a key that only one of them has raises when the rows are read."""
    a, b = left.withColumn("_in_left", F.lit(True)), right.withColumn("_in_right", F.lit(True))
    x = a.join(b, keys, "full").where(checked(F.lit(True), F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull(), "tables are not aligned"))
    return x.drop("_in_left", "_in_right")


def read_shards(spark: SparkSession, folder: str, pattern: str = "predictions.*.parquet") -> list[DataFrame]:
    """The tables that writers left as folder/predictions.<rank>.parquet, by rank as a number. None raises."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.globStatus(path) or []]
    if not found:
        raise FileNotFoundError(f"no shards like {pattern} in {folder}")
    return [spark.read.parquet(p) for p in sorted(found, key=lambda p: int(p.split(".")[-2]))]


def merge_shards(shards: list[DataFrame], keys: list[str], pos: str = "pos") -> DataFrame:
    """All shards' rows; if the positions of a group of keys are not 0, 1, ..., n - 1, each once, reading them raises."""
    x = reduce(lambda a, b: a.unionByName(b), shards)
    good = contiguous(x, keys, pos).select(*keys, F.col("ok").alias("_ok"))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    y = x.alias("a").join(good.alias("b"), same, "left")
    return y.where(checked(F.lit(True), F.col("_ok"), "positions of the shards have gaps or repeats")).select("a.*")


def samples(df: DataFrame, order: list[str], max_samples: int | None = None, max_length: int | None = None, arrays: list[str] | None = None) -> DataFrame:
    """The first samples by `order`, of each array column in `arrays` the first places. Without limits all."""
    if max_length is not None:
        df = df.withColumns({c: F.slice(c, 1, max_length) for c in arrays or [f for f, t in df.dtypes if t.startswith("array")]})
    return df if max_samples is None else df.orderBy(*order).limit(max_samples)


def strided(df: DataFrame, size: str, key: str, workers: int) -> DataFrame:
    """df with `worker`: rows longest first (ties by key) go to the workers in turn.

    The place of a row is the number of longer rows, from a table of the counts of each size, and its place among those of its size."""
    n = df.groupBy(size).agg(F.count(F.lit(1)).alias("_n"))
    before = n.select(size, F.coalesce(F.sum("_n").over(Window.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each size
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(size).orderBy(key)))
    return own.join(before, size).withColumn("worker", ((F.col("_before") + F.col("_own") - 1) % workers).cast("int")).select(*df.columns, "worker")


def group_presence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_left, in_right) of every group key of either side, by one aggregation; common groups have both."""
    side = lambda x, a, b: x.select(*keys, F.lit(a).alias("in_left"), F.lit(b).alias("in_right"))
    both = side(left, True, False).unionByName(side(right, False, True))
    return both.groupBy(*keys).agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right"))


def common_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Group keys that both sides have."""
    return group_presence(left, right, keys).where("in_left and in_right").select(*keys)
