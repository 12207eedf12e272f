"""Vectors packed into buckets by falling norm, and the block join of stated queries with all buckets.

A bucket is one row: up to BUCKET vectors with their ids, and `top`, the largest norm among them. Queries are packed alike and
dealt over blocks, buckets over lanes; a cell (block, lane) streams its buckets, largest norms first, past the queries that it
holds. So a task holds one block of queries and one bucket, whatever the norms, ids or repeated vectors are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows, materialize

BUCKET = 1024  # vectors of a bucket
BUCKET_BYTES = 1 << 19  # bytes of a bucket's vectors, one vector at least
BLOCK = 8192  # queries of a block, about
LANE = 512  # buckets of a lane, about
LIMITS = 100_000  # blocks up to which their limits are broadcast


def usable(vec: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vec, bad), F.lit(False))


def vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, vec) of the rows that take part, one for each id, written: of repeated ids the least label, then vector, stays."""
    kind = df.schema[vec_col].dataType.elementType.typeName()
    vec = F.col(f"`{vec_col}`").cast("array<float>" if kind == "float" else "array<double>")
    label = F.col(f"`{label_col}`").cast("long") if label_col else F.lit(0).cast("long")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    first = F.row_number().over(Window.partitionBy("id").orderBy("label", "vec"))
    return materialize(rows.withColumn("_n", first).where("_n = 1").drop("_n"), "vectors")


def fewest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of rows that agree in the keys, the n with the smallest ids: only those can be among the first n of anything. Spark cuts each
    task's rows to n of a key before the exchange, so a common vector is no hot key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def dtype_of(rows: DataFrame) -> str:
    return "<f4" if rows.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"


def pack(rows: DataFrame, norm: Callable[[np.ndarray], np.ndarray], lists: tuple[str, ...] = (), need: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Buckets of rows (id, label, vec, and lists: arrays of longs of one length) in their order: dim, n, top, ids, labels, vecs and the
    lists as bytes. norm gives norms of a matrix, need (norms, *lists) the smallest top that matters to each row."""
    dtype = dtype_of(rows)
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("top", pa.float64()), ("need", pa.float64())] + [(c, pa.binary()) for c in ("ids", "labels", "vecs", *lists)])
    ddl = "dim int, n int, top double, need double" + "".join(f", {c} binary" for c in ("ids", "labels", "vecs", *lists))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            vec = b.column(b.schema.get_field_index("vec"))
            dims, flat = np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            starts = np.r_[0, np.cumsum(dims)]
            more = [b.column(b.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(ids), -1) if len(ids) else None for c in lists]
            out: list[list] = [[] for _ in schema]
            at = 0
            while at < len(ids):
                d = int(dims[at])
                size = max(1, min(BUCKET, BUCKET_BYTES // max(1, d * int(dtype[-1]))))
                end = min(len(ids), at + size)
                other = np.nonzero(dims[at:end] != d)[0]
                end = at + int(other[0]) if len(other) else end
                m, own = flat[starts[at] : starts[end]].reshape(end - at, d), [x[at:end] for x in more]
                norms = norm(m.astype("f8"))
                least = float(np.min(need(norms, *own))) if need else 0.0
                for column, value in zip(out, (d, end - at, float(norms.max()), least, ids[at:end].astype("<i8").tobytes(), labels[at:end].astype("<i8").tobytes(), m.tobytes(), *(x.tobytes() for x in own)), strict=True):
                    column.append(value)
                at = end
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    arrow_rows(rows.sparkSession)
    return rows.select("id", "label", "vec", *lists).mapInArrow(packed, ddl)


def by_norm(rows: DataFrame, norm: Column) -> DataFrame:
    """rows in order of falling norm, in ranges that also split equal norms by id; lengths are kept apart."""
    x = rows.withColumn("_norm", norm).withColumn("_dim", F.size("vec"))
    return x.repartitionByRange(F.desc("_norm"), F.col("id")).sortWithinPartitions("_dim", F.desc("_norm"), "id").drop("_norm", "_dim")


def block_join(queries: DataFrame, buckets: DataFrame, search: Callable[[], object], ddl: str) -> DataFrame:
    """What search() finds in each cell of blocks of packed queries and lanes of buckets. search has add(row), bucket(row) and
    result(), which gives record batches; rows are dicts of the packed columns. Buckets below every limit of a block are not sent."""
    spark = buckets.sparkSession
    n_queries, n_buckets = queries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], buckets.count()
    blocks = max(1, -(-n_queries // BLOCK))
    lanes = max(1, min(n_buckets, max(-(-2 * spark.sparkContext.defaultParallelism // blocks), -(-n_buckets // LANE))))
    q = queries.withColumn("block", F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int"))
    b = buckets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    if blocks <= LIMITS:
        limits = q.groupBy("block").agg(F.min("need").alias("_least"))
        b = b.join(F.broadcast(limits), "block").where("top >= _least").drop("_least")
    q = q.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    x = q.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)), allowMissingColumns=True)
    x = x.repartition(blocks * lanes, "block", "lane").sortWithinPartitions("block", "lane", "part", F.desc("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if (row["block"], row["lane"]) != cell:
                    if held is not None:
                        yield from held.result()
                    cell, held = (row["block"], row["lane"]), search()
                (held.bucket if row["part"] else held.add)(row)
        if held is not None:
            yield from held.result()

    return x.mapInArrow(run, ddl)


def matrix(row: dict, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(row[name], dtype).reshape(row["n"], -1) if row["n"] and row[name] else np.zeros((row["n"], 0))


def first_of_each(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of each key with the largest score, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    begins = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]
