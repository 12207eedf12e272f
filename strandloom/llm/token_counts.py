"""Token counts: delta-maintained rollups.

count_tokens() counts each whole text by several byte-level BPE vocabularies at once: they share the pre-tokens, and a pre-token
that was seen keeps its counts in a bounded table.

A ledger is a folder of the shared file system. Each batch has an id and consists of signed events: an insert of a document's
count, a delete of it, or a revision (old count and new count). commit() sums the events by source, language and tokenizer
version (documents and tokens, signed), adds the sums to the last totals and writes new totals into a folder of this attempt
alone; they become visible by a commit file named after the version, which is renamed into place only if it is not there. A
marker for each batch says that it is committed; as a driver can die between commit and marker, the last commit's marker is made
up before anything else. So a batch id that is committed changes nothing, a batch can be run again after a death between any two
steps, no attempt writes where another one reads, and a commit reads two small files, however many there are. Totals have one row
per key and no row per document, and are additive: rollups over fewer keys are sums.

Edge cases: a null text counts as empty (0 tokens); null source, language or version are a key of their own; events with a null
count count the document with 0 tokens; keys whose documents and tokens are all back to 0 leave the totals; an empty batch is
committed and changes nothing; extra columns of events are ignored, those of counted documents stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import arrow_rows

KEYS = ["source", "lang", "version"]
EVENTS = "source string, lang string, version string, sign int, n_tokens long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


class Counter:
    """Numbers of tokens of texts under several vocabularies of one pattern."""

    def __init__(self, ranks_files: list[str], pattern: str):
        self.codecs = [bpe.codec(f, pattern) for f in ranks_files]
        self.find, self.seen = self.codecs[0].find, {}

    def piece(self, piece: str) -> tuple[int, ...]:
        made = tuple(len(c.core._encode_single_piece(piece)) for c in self.codecs)
        if len(piece) <= 64:
            if len(self.seen) >= bpe.CACHE:
                self.seen.clear()
            self.seen[piece] = made
        return made

    def counts(self, text: str | None) -> tuple[int, ...]:
        seen, new = self.seen.get, self.piece
        got = [seen(p) or new(p) for p in self.find.findall(text or "")]
        return tuple(map(sum, zip(*got, strict=True))) if got else (0,) * len(self.codecs)


def count_tokens(docs: DataFrame, ranks_files: dict[str, str], pattern: str, text_col: str = "text") -> DataFrame:
    """docs without its text, with a column for each entry of ranks_files (name: vocabulary file): the text's number of tokens."""
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c != text_col and c not in ranks_files]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(list(ranks_files.values()), pattern)
        for b in batches:
            made = [counter.counts(t) for t in b.column(len(kept)).to_pylist()]
            cols = zip(*made, strict=True) if made else [()] * len(ranks_files)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*kept, *ranks_files])

    ddl = [*(f.simpleString().split(":", 1) for f in rows.schema.fields[:-1]), *([k, "bigint"] for k in ranks_files)]
    return rows.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in ddl))


def inserts(counts: DataFrame) -> DataFrame:
    """Events for counts(source, lang, version, n_tokens)."""
    return counts.select(*KEYS, F.lit(1).alias("sign"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).alias("sign"), "n_tokens")


def revisions(counts: DataFrame, old: Column, new: Column) -> DataFrame:
    """Events that take the old count back and put the new one in."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), old.cast("long").alias("n_tokens")), F.struct(F.lit(1).alias("sign"), new.cast("long").alias("n_tokens")))
    return counts.select(*KEYS, F.inline(both))


def deltas(events: DataFrame) -> DataFrame:
    """Signed sums by key. Partial sums are made before the exchange, so a hot source costs a row for each task."""
    return events.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.coalesce(F.col("n_tokens"), F.lit(0))).alias("n_tokens"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("commits", "batches"):
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _put(self, path: str, content: dict) -> bool:
        """Creates a file whole or not at all, by a name of its own; False if it is there already. A rename onto a file must fail, as it
        does on HDFS and local file systems; stores that copy and delete instead can't hold a ledger with two writers."""
        tmp, to = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(tmp, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        done = not self._fs.exists(to) and self._fs.rename(tmp, to)
        if not done:
            self._fs.delete(tmp, False)
        return bool(done)

    def _versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits")))
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0] != ".")

    def _commit(self, version: int) -> str:
        return f"{self.path}/commits/{version:06d}.json"

    def _last(self) -> dict | None:
        """The last commit: from the pointer on, which may lag behind or be gone, so commits are listed only where it is."""
        version, pointer = None, self._path(f"{self.path}/last")
        if self._fs.exists(pointer):
            try:
                version = self._read(f"{self.path}/last")["version"]
            except ValueError:  # its writer died half-way
                version = None
        if version is None or not self._fs.exists(self._path(self._commit(version))):
            done = self._versions()
            if not done:
                return None
            version = done[-1]
        while self._fs.exists(self._path(self._commit(version + 1))):
            version += 1
        return self._read(self._commit(version))

    def _point(self, version: int) -> None:
        stream = self._fs.create(self._path(f"{self.path}/last"), True)
        stream.write(json.dumps({"version": version}).encode())
        stream.close()

    def _marker(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def batches(self) -> list[str]:
        """All batch ids in the order of their commits; reads every commit."""
        return [self._read(self._commit(n))["batch"] for n in self._versions()]

    def _totals(self, last: dict | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{last['data']}")

    def totals(self) -> DataFrame:
        return self._totals(self._last())

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Applies a batch once. Returns whether this call applied it. Two writers at once: one of them gets an error."""
        last = self._last()
        if last is not None:
            self._put(self._marker(last["batch"]), last)  # a driver may have died before it was made
        if self._fs.exists(self._path(self._marker(batch))):
            return False
        version = 0 if last is None else last["version"] + 1
        made = {"version": version, "batch": batch, "data": f"totals-{version:06d}-{uuid.uuid4().hex}"}
        new = self._totals(last).unionByName(deltas(events).select("source", "lang", "version", "n_docs", "n_tokens"))
        new = new.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        new.write.parquet(f"{self.path}/{made['data']}")
        if not self._put(self._commit(version), made):
            raise RuntimeError(f"version {version} was committed by another writer; run the batch again")
        self._put(self._marker(batch), made)
        self._point(version)
        return True


def rollup(totals: DataFrame) -> DataFrame:
    """Totals by version with all sources and languages, by source, by language, and by both; level says which are kept."""
    both = totals.groupBy("version", "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumn("level", F.lit("source,lang"))
    sums = lambda *keys: totals.groupBy("version", *keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumn("level", F.lit(",".join(keys)))
    return both.unionByName(sums("source"), True).unionByName(sums("lang"), True).unionByName(sums(), True)
