"""Phrase collocations: counts of all n-grams up to max_n words, scores from prefix and suffix counts, and ranks for each language.

Texts are exploded into rows of n-grams, which are summed for each language. A phrase that occurs at least min_count times consists
of phrases that do, and so do the parts that its cuts need. So n-grams with a word, or for three and more words with a pair of
words, below min_count can't matter, and most are left out before they become rows: a bitmap of the hashes of all words (pairs) that
are frequent goes to every task. It never leaves out a frequent one; another one whose bit is set is counted in vain. Its size
follows the counted number of frequent phrases, up to BITS at most; beyond that more is counted in vain. Each task sums equal
n-grams of a batch by exact ids before it hands them on, a slice of phrases at a time, and Spark sums them by their text.

Defined results: null texts are empty; a null language is `und`; rows are counted as often as they are there; other columns are not
read; texts without words and empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows, materialize

BITS = 28  # a bitmap has 2^28 bits (32 MB) at most
PHRASES = 1 << 15  # rows of a record batch
COUNTS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, "u1")
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A mixer of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its beginning (of the language, at first) and its last word's."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def checksums(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, values), "u8", len(values))


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype("i8")] >> (slot & np.uint64(63))) & np.uint64(1) == 1


class Words:
    """The words of a batch of texts: ids, hashes and places in one buffer in which a blank follows each word."""

    def __init__(self, texts: list[bytes | None], langs: list[str]):
        self.names, lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
        raw = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), "u1")  # a break ends every text
        kind = KIND[raw]
        word = kind == WORD
        edge = np.diff(word.view("i1"), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == BREAK), start)
        doc = np.searchsorted(np.cumsum([len(t or b"") + 1 for t in texts]), start, "right")
        self.lang = lang[doc] if len(start) else np.zeros(0, "i8")
        size = end - start
        low = LOWER[raw]
        letters, at = low[word], np.r_[0, np.cumsum(size)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype("i8")), pa.py_buffer(letters)]).dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy().astype("i8"), coded.dictionary.to_pylist()
        self.crc = checksums(self.vocabulary)[self.ids] if len(start) else np.zeros(0, "u8")
        self.base = mix(checksums([x.encode() for x in self.names]))[self.lang]
        low[end] = 0x20
        word[end] = True
        self.text, self.at = low[word], np.r_[0, np.cumsum(size + 1)]

    def starts(self, n: int) -> np.ndarray:
        """Places of n-grams that stay within a piece."""
        m = len(self.ids) - n + 1
        return np.flatnonzero(self.piece[:m] == self.piece[n - 1 :]) if m > 0 else np.zeros(0, "i8")

    def frequent(self, n: int, bitmap: np.ndarray) -> np.ndarray:
        """For each place whether the n-gram from there on may be frequent; those that leave their piece are not."""
        found, at = np.zeros(len(self.ids), bool), self.starts(n)
        h = self.base[at]
        for j in range(n):
            h = chained(h, self.crc[at + j])
        found[at] = has(bitmap, h)
        return found

    def counts(self, n: int, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of the n-grams at these places by language, PHRASES at a time."""
        key, size = self.lang[at] * len(self.vocabulary) + self.ids[at], len(self.vocabulary)
        code, distinct = pd.factorize(key)
        for j in range(1, n):
            code, distinct = pd.factorize(code * size + self.ids[at + j])
        first = np.zeros(len(distinct), "i8")
        first[code[::-1]] = at[::-1]
        times = np.bincount(code, minlength=len(first)).astype("i8")
        del key, code, distinct
        names = pa.array(self.names, pa.string())
        for k in range(0, len(first), PHRASES):
            some = first[k : k + PHRASES]
            begin, length = self.at[some], self.at[some + n] - 1 - self.at[some]
            offset = np.r_[0, np.cumsum(length)]
            letters = self.text[np.repeat(begin - offset[:-1], length) + np.arange(offset[-1])]
            phrase = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offset.astype("i8")), pa.py_buffer(letters)]).cast(pa.string())
            lang = pa.DictionaryArray.from_arrays(pa.array(self.lang[some], pa.int32()), names).cast(pa.string())
            yield pa.record_batch([lang, pa.array(np.full(len(some), n, "i4")), phrase, pa.array(times[k : k + PHRASES])], schema=COUNTS)


def exploded(docs: DataFrame, sizes: range, given: int = 0, bitmap=None) -> DataFrame:
    """(lang, n, phrase, f): partial counts of n-grams of these sizes in which all given-grams may be frequent. With words also their
    number, as n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, "u8") if bitmap is not None else None
        for b in batches:
            w = Words(b.column(1).to_pylist(), b.column(0).to_pylist())
            if sizes[0] == 1 and len(w.ids):
                total = np.bincount(w.lang, minlength=len(w.names))
                yield pa.record_batch([pa.array(w.names, pa.string()), pa.array(np.zeros(len(total), "i4")), pa.array([""] * len(total)), pa.array(total.astype("i8"))], schema=COUNTS)
            ok = w.frequent(given, bits) if given else None
            for n in sizes:
                at = w.starts(n)
                for j in range(n - given + 1 if given else 0):
                    at = at[ok[at + j]]
                if len(at):
                    yield from w.counts(n, at)

    arrow_rows(docs.sparkSession)
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, n int, phrase string, f long")


def frequent_bits(grams: DataFrame) -> bytes:
    """The bitmap of the hashes of all these phrases; what comes to the driver is the bitmap itself, 2^BITS bits at most."""
    spark = grams.sparkSession
    log = min(BITS, max(16, (16 * grams.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = b.column(0).to_pylist(), b.column(1).to_pylist()
            words = [p.encode().split(b" ") for p in phrases]
            h = mix(checksums([x.encode() for x in langs]))
            for j in range(len(words[0]) if words else 0):  # phrases of one length
                h = chained(h, checksums([w[j] for w in words]))
            slot = h & np.uint64((1 << log) - 1)
            yield pa.record_batch([pa.array((slot >> np.uint64(6)).astype("i8")), pa.array((np.uint64(1) << (slot & np.uint64(63))).view("i8"))], names=["at", "bits"])

    found = grams.select("lang", "phrase").mapInArrow(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log - 6), "i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def count_grams(docs: DataFrame, max_n: int = 4, min_count: int = 30) -> DataFrame:
    """(lang, n, phrase, f) of all phrases of up to max_n words with f >= min_count; a row with n = 0 has a language's number of words."""
    spark, tables, bitmap = docs.sparkSession, [], None
    for given, sizes in ((0, range(1, 2)), (1, range(2, 3)), (2, range(3, max_n + 1))):
        if not len(sizes) or sizes[0] > max_n:
            continue
        bitmap = spark.sparkContext.broadcast(frequent_bits(tables[-1].where(F.col("n") == given))) if given else None
        sums = exploded(docs, sizes, given, bitmap).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
        tables.append(materialize(sums.where((F.col("n") == 0) | (F.col("f") >= min_count)), f"grams{sizes[0]}", narrow=True))
        if bitmap is not None:
            bitmap.unpersist()
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def words_of(first: int, n) -> F.Column:
    """n words of the array `w` from place `first` on, as a phrase."""
    return F.array_join(F.slice("w", F.lit(first) if isinstance(first, int) else first, n), " ")


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score, then count, then text.

    A phrase of count a, cut after its first k words into parts of counts l and r, scores floor(scale * a / (l + r)); its lowest cut
    counts. Phrases inside a longer one that occurs at least share as often are dropped: a count never grows with a word more, so
    extensions by one word decide that."""
    grams = count_grams(docs, max_n, min_count)
    whole = grams.where("n > 0").select("lang", "phrase", "f")
    cand = grams.where("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", words_of(1, F.col("k")).alias("_first"), words_of(F.col("k") + 1, F.col("size") - F.col("k")).alias("_rest"))
    cut = cut.join(whole.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"]).join(whole.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"])
    exact = lambda c: c.cast("decimal(19,0)")
    product = (F.lit(scale).cast("decimal(18,0)") * exact(F.col("a"))).cast("decimal(38,0)")
    cut = cut.withColumn("score", F.call_function("div", product, (exact(F.col("l")) + exact(F.col("r"))).cast("decimal(20,0)")))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    longer = cand.where("size > 2").select("lang", F.col("a").alias("_f"), F.explode(F.array(words_of(1, F.col("size") - 1), words_of(2, F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    kept = scored.join(longer.withColumnsRenamed({"lang": "_lang", "phrase": "_phrase"}), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (exact(F.col("_f")) * share[1] >= exact(F.col("a")) * share[0]), "left_anti")
    x = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    x = x.withColumn("rank", rank).where(F.col("rank") <= top)
    total = grams.where("n = 0").select("lang", F.col("f").alias("n"))
    return x.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
