"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm and packed into buckets. Two searches run over them: the first k rows of an anchor's own label are its
positives, and each positive's score opens a window [low, high] percent of it, in which the first rows of other labels are its
negatives. By Cauchy and Schwarz no row of a bucket scores above the anchor's norm times the bucket's largest norm. A bucket is
left out for a window whose lower limit, or whose running k-th score, lies above that bound; a bucket below all limits of a block
of anchors is not even sent there. All scores are exact integers.

Defined results: rows with a null id or label, or a vector that is null or holds null or non-finite components, take no part. Rows of
one id count once (the least label, then vector). Vectors of other lengths have no score with an anchor; empty ones score 0.
Negative positive scores leave empty windows. Scores beyond a long are taken as the largest or smallest long. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .vector_blocks import block_join, by_norm, dtype_of, fewest, first_of_each, matrix, pack, vectors

ANY = (1 << 63) - 1  # limits of a window that has none
SLACK = 1 + 1e-9  # norms are rounded
CHUNK = 1 << 22  # scores that are looked at together
FOUND = pa.schema([("anchor_id", pa.int64()), ("mark", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def product(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer rows held as doubles; most: no product is larger. Beyond 2^53 by Python's integers."""
    if most < 2.0**53:
        return (q @ c.T).astype("i8")
    exact = np.array([[int(x) for x in row] for row in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in row] for row in c], dtype=object).reshape(c.shape).T
    return np.clip(exact, -ANY, ANY).astype("i8")


class WindowSearch:
    """The first k candidates of the same or of another label in each window of each anchor of a block."""

    def __init__(self, k: int, same: bool, scale: int, dtype: str):
        self.k, self.same, self.scale, self.dtype, self.rows, self.by_dim = k, same, scale, dtype, [], None

    def add(self, row: dict) -> None:
        self.rows.append(row)

    def integers(self, row: dict) -> np.ndarray:
        return np.floor(np.frombuffer(row["vecs"], self.dtype).astype("f8").reshape(row["n"], row["dim"]) * self.scale)

    def start(self) -> None:
        self.by_dim = {}
        for d in {r["dim"] for r in self.rows}:
            own = [r for r in self.rows if r["dim"] == d]
            v = np.concatenate([self.integers(r) for r in own])
            a = {"v": v, "norm": np.sqrt((v * v).sum(1)), "ids": np.concatenate([matrix(r, "ids", "<i8")[:, 0] for r in own]), "labels": np.concatenate([matrix(r, "labels", "<i8")[:, 0] for r in own])}
            a |= {c: np.concatenate([matrix(r, c, "<i8") for r in own]) for c in ("lo", "hi", "marks")}
            a["least"] = a["lo"].copy()  # the lower limit or the running k-th score
            a["found"] = [np.zeros(0, "i8")] * 3  # key of anchor and window, score, id
            self.by_dim[d] = a
        self.rows = []

    def bucket(self, row: dict) -> None:
        if self.by_dim is None:
            self.start()
        a = self.by_dim.get(row["dim"])
        if a is None:
            return
        limit = np.maximum(a["norm"][:, None] * row["top"] * SLACK, 0)
        open_ = (a["least"] <= limit) & (a["lo"] <= a["hi"])
        anchors = np.nonzero(open_.any(1))[0]
        if not len(anchors):
            return
        c, ids, labels = self.integers(row), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        most, hits = float(a["norm"].max(initial=0)) * row["top"] * SLACK, [[], [], []]
        step = max(1, CHUNK // row["n"])
        for at in range(0, len(anchors), step):
            some = anchors[at : at + step]
            s = product(a["v"][some], c, most)
            fit = (a["labels"][some][:, None] == labels[None, :]) == self.same
            fit &= a["ids"][some][:, None] != ids[None, :]
            for w in range(a["lo"].shape[1]):
                rows = np.nonzero(open_[some, w])[0]
                if not len(rows):
                    continue
                least, hi = a["least"][some[rows], w], a["hi"][some[rows], w]
                sw = s[rows]
                ok = fit[rows] & (sw >= least[:, None]) & (sw <= hi[:, None])
                if row["n"] > self.k:  # only the k best of this bucket, and their ties, go on
                    best = np.where(ok, sw, -ANY)
                    ok &= sw >= np.partition(best, row["n"] - self.k, axis=1)[:, row["n"] - self.k][:, None]
                i, j = np.nonzero(ok)
                for store, value in zip(hits, (some[rows[i]] * a["lo"].shape[1] + w, sw[i, j], ids[j]), strict=True):
                    store.append(value)
        if any(len(x) for x in hits[0]):
            key, score, found = (np.concatenate([old, *new]) for old, new in zip(a["found"], hits, strict=True))
            top = first_of_each(key, score, found, self.k)
            a["found"] = [key[top], score[top], found[top]]
            count = np.bincount(a["found"][0], minlength=a["lo"].size)
            last = np.cumsum(count) - 1
            full = np.nonzero(count >= self.k)[0]
            least = a["least"].reshape(-1)
            least[full] = np.maximum(least[full], a["found"][1][last[full]])

    def result(self) -> Iterator[pa.RecordBatch]:
        for a in (self.by_dim or {}).values():
            key, score, ids = a["found"]
            w = a["lo"].shape[1]
            for at in range(0, len(key), 50_000):
                part = slice(at, at + 50_000)
                yield pa.record_batch([pa.array(x) for x in (a["ids"][key[part] // w], a["marks"].reshape(-1)[key[part]], ids[part], score[part])], schema=FOUND)


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchors` holds (a condition on
    the column id) and each of its first `positives` rows of the same label the first `negatives` rows of other labels whose score lies
    between low and high percent of the positive's. A component counts as floor(scale * x)."""
    rows = vectors(df, id_col, vec_col, label_col)
    dtype = dtype_of(rows)

    def norm(m: np.ndarray) -> np.ndarray:
        v = np.floor(m * scale)
        return np.sqrt((v * v).sum(1))

    square = lambda s, x: s + F.floor(x.cast("double") * scale).cast("double") * F.floor(x.cast("double") * scale).cast("double")
    kept = fewest(rows, ["vec", "label"], max(positives + 1, negatives))
    buckets = materialize(pack(by_norm(kept, F.aggregate("vec", F.lit(0.0), square)), norm), "buckets", narrow=True)
    queries = rows.where(anchors)
    best = lambda x, keys, n: x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)

    whole = queries.withColumns({"lo": F.array(F.lit(-ANY)), "hi": F.array(F.lit(ANY)), "marks": F.array(F.lit(0).cast("long"))})
    ddl = "anchor_id long, mark long, id long, score long"
    first = block_join(pack(whole, norm, ("lo", "hi", "marks"), lambda n, *_: np.zeros(len(n))), buckets, lambda: WindowSearch(positives, True, scale, dtype), ddl)
    found = materialize(best(first, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", narrow=True)

    # exact floors of percents: products may pass 64 bits
    floor = lambda x: ((x - F.pmod(x, F.lit(100).cast("decimal(38,0)"))) / F.lit(100)).cast("decimal(38,0)")
    score = F.col("positive_score").cast("decimal(25,0)")
    bound = lambda x: F.least(F.greatest(x, F.lit(-ANY).cast("decimal(38,0)")), F.lit(ANY).cast("decimal(38,0)")).cast("long")
    windows = found.withColumn("lo", bound(-floor((-score * F.lit(low)).cast("decimal(38,0)")))).withColumn("hi", bound(floor((score * F.lit(high)).cast("decimal(38,0)"))))
    windows = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "lo", "hi"))).alias("w"))  # at most `positives` of them
    padded = lambda field, missing: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[field], F.lit(missing).cast("long")))
    opened = queries.join(windows, F.col("id") == F.col("anchor_id")).withColumns({"lo": padded("lo", 1), "hi": padded("hi", 0), "marks": padded("positive_id", 0)})

    def need(norms: np.ndarray, lo: np.ndarray, hi: np.ndarray, marks: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(lo <= hi, np.where(lo > 0, lo / (norms[:, None] * SLACK), 0.0), np.inf)
        return np.nan_to_num(x, nan=0.0, posinf=np.inf).min(1)

    second = block_join(pack(opened, norm, ("lo", "hi", "marks"), need), buckets, lambda: WindowSearch(negatives, False, scale, dtype), ddl)
    negative = best(second, ["anchor_id", "mark"], negatives).select("anchor_id", F.col("mark").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negative.join(found, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
