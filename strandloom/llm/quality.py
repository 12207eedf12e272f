"""Quality classifier by importance resampling.

Two generative models of hashed word 1- and 2-grams, target (documents labelled good and not toxic) and raw (all documents),
are multinomials over BUCKETS buckets with add-one smoothing. A document's log weight is the log ratio of its probabilities
under both models, that is the sum of the log ratios of its n-grams; per_gram takes their mean instead, so that length does not
decide. Documents are drawn without replacement by Gumbel top-k: the k largest of log weight plus Gumbel noise, the noise being a
function of seed and doc_id. k is SHARE of the rows. The cut is found exactly by narrowing the interval that holds the k-th key,
counting keys in 1,024 parts at a time; ties at the cut go to the smaller doc_id.

Edge cases: null and wordless texts have weight 0 and take part; without labelled rows all weights are 0; rows with equal
ids and texts have equal keys, and where the cut falls among rows of one key and id, so many of them are kept as there is room
for (each is numbered by its place in the written table); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows, materialize

BUCKETS, TARGET_ROWS, SHARE, SEED = 1 << 13, 8192, (4, 5), 23
_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(text: str | None) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words of a whole text."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, int)
    if not len(begin):
        return np.zeros(0, np.int64)
    # a word's hash: sum of random numbers of its bytes times powers of an odd number by place
    place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw)))) if begin[0] == 0 else np.arange(len(raw)) - np.concatenate([np.zeros(begin[0], int), np.repeat(begin, np.diff(np.append(begin, len(raw))))])
    value = np.where(space, np.uint64(0), _TABLE[raw] * _POWERS[place & 255])
    word = np.add.reduceat(value, begin)
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
    pair ^= pair >> np.uint64(31)
    both = np.concatenate([word, pair * np.uint64(0x94D049BB133111EB)])
    return (both >> np.uint64(64 - 13)).astype(np.int64)


_POWERS = np.cumprod(np.full(256, np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)


def _counts(docs: DataFrame) -> np.ndarray:
    """Sum of n-gram counts over all rows of docs: one vector per task, summed in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                g = grams(t)
                if len(g):
                    total += np.bincount(g, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for v in b.column(1).to_pylist():
                total += np.frombuffer(v, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    parts = docs.select("text").mapInArrow(run, "k long, v binary").repartition(16).mapInArrow(merge, "k long, v binary")
    got = [np.frombuffer(r.v, np.int64) for r in parts.collect()]  # at most 16 vectors of BUCKETS numbers
    return sum(got, np.zeros(BUCKETS, np.int64))


def target_rows(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """Documents labelled good and not toxic: at most `most`, those with the smallest hash of the id."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(most)
    docs = docs.select("doc_id", "text")
    return docs.join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left_semi")  # at most `most` ids


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's probability under both models; 0 without target rows."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weight(text: str | None, ratio: np.ndarray, per_gram: bool = False) -> float:
    g = grams(text)
    return float(ratio[g].mean() if per_gram else ratio[g].sum()) if len(g) else 0.0


def weights(docs: DataFrame, ratio: np.ndarray, per_gram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight) of every row."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([weight(t, r, per_gram) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "log_weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, log_weight double")


def gumbel_key(seed: int = SEED):
    """Log weight plus Gumbel noise from the hash of seed and doc_id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.col("log_weight") - F.log(-F.log(u))


def top_k(rows: DataFrame, k: int, key: str = "key") -> DataFrame:
    """rows (a written table with doc_id and key) with `kept`: whether the row is among the k with the largest keys."""
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn("kept", F.lit(True))
    above = 0  # rows over the interval [low, high]
    for _ in range(8):
        inside = rows.where(F.col(key).between(low, high))
        step = (high - low) / 1024
        if step <= 0 or low + step <= low:
            break
        part = F.least(F.floor((F.col(key) - low) / step), F.lit(1023)).cast("int")
        sums = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).orderBy(F.desc("p")).collect()  # at most 1,024
        for s in sums:
            if above + s.n >= k:
                low, high, n = s.a, s.b, s.n  # equal bounds: ties, numbered below
                break
            above += s.n
        if n <= 10_000:
            break
    # the narrowed interval: ids in order are counted by slices of their range, so that no task holds all ties
    inside = rows.where(F.col(key).between(low, high)).withColumn("_at", F.monotonically_increasing_id())
    edge = Window.partitionBy("_slice").orderBy(F.desc(key), F.col("doc_id").asc_nulls_first(), "_at")
    inside = materialize(inside.repartitionByRange(F.desc(key), F.col("doc_id").asc_nulls_first(), "_at").withColumn("_slice", F.spark_partition_id()), "edge", True)
    base = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = inside.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(base), F.lit(0))).select("_slice", "_base")
    inside = inside.withColumn("_k", F.row_number().over(edge)).join(F.broadcast(before), "_slice").withColumn("kept", F.col("_base") + F.col("_k") <= k - above).select(*rows.columns, "kept")
    outside = rows.where(~F.col(key).between(low, high)).withColumn("kept", F.col(key) > high)
    return outside.unionByName(inside)


def importance_resample(docs: DataFrame, labels: DataFrame, share: tuple[int, int] = SHARE, seed: int = SEED, per_gram: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, score (logistic of the weight), key and kept."""
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratio = log_ratio(_counts(target_rows(docs, labels)), _counts(docs))
    rows = materialize(weights(docs, ratio, per_gram).withColumn("key", gumbel_key(seed)), "weights")
    k = rows.count() * share[0] // share[1]
    return top_k(rows, k).select("doc_id", "log_weight", (1 / (1 + F.exp(-F.col("log_weight")))).alias("score"), "key", "kept")
