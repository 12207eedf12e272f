"""Byte-level BPE encoding and decoding.

Texts of more than CHUNK characters are cut into chunks that overlap by OVERLAP characters, and the chunks are dealt over the
cluster. Each chunk is pre-tokenised from its own start, in parallel. A chunk's first boundaries may be wrong, because it
starts anywhere, but a boundary that the chunk before it also has is a point where both resynchronise: the pattern reads
from left to right, so from there on both go on alike. Each chunk therefore encodes the pieces from the first common
boundary with its predecessor to the first common one with its successor. If some pair of neighbours has no common boundary
in the overlap, the chunks of that text are joined again and it is encoded as one. Shorter texts are one chunk and are encoded
where they are read. Decoding concatenates the tokens' raw bytes.

The pre-token pattern must look at most one character ahead beyond a match. Boundaries that lie so near the end of a chunk
that more text could change them are not used.

Edge cases: a null text equals the empty text (no tokens; the digests of nothing); repeated rows and ids are one row each;
an empty table gives no rows; other columns are ignored; lone surrogates can't occur in Spark's strings.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows

CHUNK, OVERLAP, CACHE = 1 << 16, 1 << 10, 1 << 17


class Codec:
    """Ranks and pattern of a byte-level BPE; pieces that were seen keep their ids in a bounded table."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.find = regex.compile(pattern)
        self.core = tiktoken.Encoding(f"codec-{uuid.uuid4().hex}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {v: k for k, v in ranks.items()}
        self.seen: dict[str, tuple[int, str, bytes]] = {}

    def pieces(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """Pre-tokens from the boundary start to the boundary stop. Text past stop is still looked at."""
        if not start and stop is None:
            return iter(self.find.findall(text))
        return (m[0] for m in self.find.finditer(text, start) if m.start() < (len(text) if stop is None else stop))

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Starts in [low, high) of the pre-tokens of text, read from its first character."""
        return [m.start() for m in self.find.finditer(text) if low <= m.start() < high]

    def encode_piece(self, piece: str) -> tuple[int, str, bytes]:
        """(number of ids, decimal ids each followed by a comma, decoded bytes)."""
        ids = self.core._encode_single_piece(piece)
        made = (len(ids), "".join(f"{i}," for i in ids), b"".join(map(self.token.__getitem__, ids)))
        if len(piece) <= 64:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[piece] = made
        return made

    def encode(self, text: str, start: int = 0, stop: int | None = None) -> tuple[int, bytes, bytes]:
        """(number of ids, decimal ids each followed by a comma, decoded bytes) of a stretch between two boundaries."""
        seen, new = self.seen.get, self.encode_piece
        got = [seen(p) or new(p) for p in self.pieces(text, start, stop)]
        if not got:
            return 0, b"", b""
        n, ids, raw = zip(*got, strict=True)
        return sum(n), "".join(ids).encode(), b"".join(raw)

    def ids(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.core._encode_single_piece(p)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.token[i] for i in ids)


@functools.lru_cache(2)
def codec(ranks_file: str, pattern: str) -> Codec:
    return Codec(ranks_file, pattern)


PART = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64())])
RESULT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def _digest(n: int, ids: bytes, raw: bytes) -> tuple:
    return n, hashlib.sha256(memoryview(ids)[:-1] if ids else b"").hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)


def _to_columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def stitched(long_docs: DataFrame, ranks_file: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, _row, part, text, start, stop): stretches between true pre-token boundaries that together cover each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("part", pa.int64()), ("text", pa.string())])
        for b in batches:
            for doc, row, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for at in range(0, len(text), 64 * chunk):
                    yield _to_columns([(doc, row, k // chunk, text[k : k + chunk + overlap]) for k in range(at, min(len(text), at + 64 * chunk), chunk)], schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            head, tail = [], []
            for part, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                safe = len(text) - 1 if len(text) == chunk + overlap else len(text)  # more text may follow
                all_of = c.boundaries(text, 0, safe)
                head.append([x for x in all_of if x < overlap] if part else [0])
                tail.append([x - chunk for x in all_of if x >= chunk])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=[*b.schema.names, "head", "tail"])

    ddl = "doc_id long, _row long, part long, text string"
    parts = long_docs.mapInArrow(cut, ddl).repartition("doc_id", "_row", "part").mapInArrow(scan, f"{ddl}, head array<int>, tail array<int>")
    doc = Window.partitionBy("doc_id", "_row")
    near = doc.orderBy("part")
    common = lambda a, b: F.array_min(F.array_intersect(a, b))
    start = F.when(F.col("part") == 0, F.lit(0)).otherwise(common("head", F.lag("tail").over(near)))
    more = F.lead("head").over(near)
    stop = F.when(more.isNotNull(), common("tail", more) + F.lit(chunk))
    parts = parts.withColumn("start", start).withColumn("stop", stop).drop("head", "tail")
    parts = parts.withColumn("whole", F.max(F.col("start").isNull()).over(doc))
    joined = parts.where("whole").withColumn("text", F.when(F.col("stop").isNull() & (F.col("part") == F.max("part").over(doc)), F.col("text")).otherwise(F.substring("text", 1, chunk)))
    joined = joined.groupBy("doc_id", "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))  # the chunks of one text
    joined = joined.select("doc_id", "_row", F.lit(0).cast("long").alias("part"), "text", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"))
    return parts.where(~F.col("whole")).drop("whole").unionByName(joined)


def encode_parts(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, _row, part, n, ids, raw) of the texts longer than a chunk: the encoded stretches of each, decimal ids and decoded bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            yield _to_columns([(doc, row, part, *c.encode(text, start, stop)) for doc, row, part, text, start, stop in zip(*(x.to_pylist() for x in b.columns), strict=True)], PART)

    return stitched(docs, ranks_file, pattern, chunk, overlap).mapInArrow(encode, "doc_id long, _row long, part long, n long, ids binary, raw binary")


def bpe_digests(docs: DataFrame, ranks_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes (of the decoded bytes)."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            yield _to_columns([(doc, *_digest(*c.encode(text))) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], RESULT)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by text and part: digests are carried on from part to part, so no text is held as a whole."""
        now, doc, n, size, ids, raw, comma = None, None, 0, 0, hashlib.sha256(), hashlib.sha256(), b""
        done = []
        for b in batches:
            for d, row, _, k, a, r in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (d, row) != now:
                    if now is not None:
                        done.append((doc, n, ids.hexdigest(), raw.hexdigest(), size))
                    now, doc, n, size, ids, raw, comma = (d, row), d, 0, 0, hashlib.sha256(), hashlib.sha256(), b""
                if a:
                    ids.update(comma)
                    ids.update(memoryview(a)[:-1])
                    comma = b","
                raw.update(r)
                n, size = n + k, size + len(r)
            yield _to_columns(done, RESULT)
            done = []
        if now is not None:
            yield _to_columns([(doc, n, ids.hexdigest(), raw.hexdigest(), size)], RESULT)

    long_docs = rows.where(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    parts = encode_parts(long_docs, ranks_file, pattern, chunk, overlap)
    from_long = parts.repartition("doc_id", "_row").sortWithinPartitions("doc_id", "_row", "part").mapInArrow(gather, RESULT_DDL)
    return rows.where(F.length("text") <= chunk).mapInArrow(short, RESULT_DDL).unionByName(from_long)


def decode_ids(rows: DataFrame, ranks_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column `decoded`: the raw bytes of an array of ids, concatenated. A null array gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or []) for x in b.column(at).to_pylist()], pa.binary())], names=[*b.schema.names, "decoded"])

    at = rows.columns.index(ids_col)
    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", BinaryType()))


def encode_ids(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids themselves, as an array; each text is encoded as one."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(c.ids(t or ""), np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
