"""Nearest neighbours by cosine, as a block matrix join with int8 tiles.

Vectors are scaled to length one and rounded to 127 steps of their largest component. The product of two int8 tiles, held exactly, is
the cosine but for an error that the lengths of the two rounding errors bound. A candidate goes on only where product plus bound
reaches the query's running k-th score; those are computed again in double precision on the original components and kept in a
heap for each query. The result is exact: recall is 1.

Defined results: rows with a null id, or a vector that is null, zero or holds null or non-finite components, take no part. Rows of
one id count once (the least vector). Vectors of other lengths are not compared. Scores are clipped to [-1, 1]. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .vector_blocks import block_join, by_norm, dtype_of, fewest, pack, vectors

STEPS = 127
SLICE = 1024  # components whose int8 products a float32 adds exactly: 1024 * 127^2 < 2^24
ROUND = 1e-9  # more than what double precision adds to the bounds
CHUNK = 1 << 22
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: cosines stay the same bit by bit, squares stay finite."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0))[1][:, None])


def squares(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for d in range(m.shape[1]):  # from left to right, as a plain loop over the components adds
        total += m[:, d] * m[:, d]
    return total


def cosines(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows; aa and bb are the sums of squares."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return np.clip(total / np.sqrt(aa * bb), -1.0, 1.0)


class Tile:
    """Vectors with int8 codes: unit vector = step * code + rest."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray):
        self.ids, self.v = ids, scaled(vecs)
        self.sq = squares(self.v)
        unit = self.v / np.sqrt(self.sq)[:, None]
        self.step = np.abs(unit).max(1) / STEPS
        self.code = np.rint(unit / self.step[:, None]).astype("i1")
        back = self.code * self.step[:, None]
        self.rest, self.size = np.sqrt(((unit - back) ** 2).sum(1)), np.sqrt((back**2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLICE):
        part = slice(at, at + SLICE)
        total += a[:, part].astype("f4") @ b[:, part].astype("f4").T
    return total


class TileSearch:
    """The k nearest candidates of each query of a block."""

    def __init__(self, k: int, dtype: str):
        self.k, self.dtype, self.rows, self.by_dim = k, dtype, [], None

    def add(self, row: dict) -> None:
        self.rows.append(row)

    def tile(self, *rows: dict) -> Tile:
        return Tile(np.concatenate([np.frombuffer(r["vecs"], self.dtype).astype("f8").reshape(r["n"], r["dim"]) for r in rows]), np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows]))

    def bucket(self, row: dict) -> None:
        if self.by_dim is None:
            self.by_dim = {}
            for d in {r["dim"] for r in self.rows}:
                t = self.tile(*(r for r in self.rows if r["dim"] == d))
                self.by_dim[d] = (t, np.full(len(t.ids), -np.inf), [[] for _ in t.ids])
            self.rows = []
        if row["dim"] not in self.by_dim:
            return
        (q, kth, heaps), c = self.by_dim[row["dim"]], self.tile(row)
        step = max(1, CHUNK // row["n"])
        for at in range(0, len(q.ids), step):
            part = slice(at, at + step)
            near = products(q.code[part], c.code) * q.step[part, None] * c.step[None, :]
            off = q.rest[part, None] * c.size[None, :] + c.rest[None, :] + ROUND
            own = q.ids[part, None] == c.ids[None, :]
            least = kth[part].copy()
            if row["n"] > self.k:  # the k-th of the lower bounds in this bucket is one for the k-th score as well
                low = np.where(own, -np.inf, near - off)
                least = np.maximum(least, np.partition(low, row["n"] - self.k, axis=1)[:, row["n"] - self.k])
            i, j = np.nonzero((near + off >= least[:, None]) & ~own)
            score = cosines(q.v[at + i], c.v[j], q.sq[at + i], c.sq[j])
            for a, s, x in zip((at + i).tolist(), score.tolist(), c.ids[j].tolist(), strict=True):
                heap = heaps[a]
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -x))
                elif (s, -x) > heap[0]:
                    heapq.heapreplace(heap, (s, -x))
            for a in np.unique(at + i).tolist():
                if len(heaps[a]) == self.k:
                    kth[a] = heaps[a][0][0]

    def result(self) -> Iterator[pa.RecordBatch]:
        for q, _, heaps in (self.by_dim or {}).values():
            for at in range(0, len(heaps), 8192):
                rows = [(i, -x, s) for i, heap in zip(q.ids[at : at + 8192].tolist(), heaps[at : at + 8192], strict=True) for s, x in heap]
                yield pa.record_batch([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(FOUND)], schema=FOUND)


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row where `queries` holds (a condition on the column id)."""
    rows = vectors(df.where(F.exists(F.col(f"`{vec_col}`"), lambda x: x != 0)), id_col, vec_col)
    dtype = dtype_of(rows)
    norm = lambda m: np.sqrt((m * m).sum(1))
    square = lambda s, x: s + x.cast("double") * x.cast("double")
    buckets = materialize(pack(by_norm(fewest(rows, ["vec"], k + 1), F.aggregate("vec", F.lit(0.0), square)), norm), "tiles", narrow=True)
    found = block_join(pack(rows.where(queries), norm), buckets, lambda: TileSearch(k, dtype), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
