"""FASTA records and sequence blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import written

BLOCK = 1 << 20
PIECE = 1 << 16  # bases of a row of scan() at most
SLICE = 1 << 14  # width of the blocks that cut() takes bases from; each place walks through half a block on average


def pieces(lines: DataFrame) -> DataFrame:
    """(path, split, seg, title, at, dna) from lines (path, split, value) in the order of the scan: seg counts the records that begin in a
    split, 0 is what stands before the first of them. A piece has PIECE bases at most, and every segment has one, perhaps an empty one."""
    schema = pa.schema([("path", pa.string()), ("split", pa.int64()), ("seg", pa.int64()), ("title", pa.string()), ("at", pa.int64()), ("dna", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seg, title, at, held, size, made = None, 0, None, 0, [], 0, [[] for _ in schema]

        def out(final: bool) -> None:
            nonlocal at, held, size
            whole = b"".join(held).translate(None, b" \t\r\n\x0b\x0c").decode()
            for k in range(0, max(len(whole), 1) if at == 0 else len(whole), PIECE):
                if not final and len(whole) - k < PIECE:
                    break
                for column, v in zip(made, (*here, seg, title, at + k, whole[k : k + PIECE]), strict=True):
                    column.append(v)
            done = len(whole) if final else len(whole) - len(whole) % PIECE
            held, at = [whole[done:].encode()], at + done
            size = len(whole) - done

        for b in batches:
            paths, splits, values = (b.column(k).to_pylist() for k in range(3))
            for path, split, value in zip(paths, splits, values, strict=True):
                if (path, split) != here:
                    if here is not None:
                        out(True)
                    here, seg, title, at, held, size = (path, split), 0, None, 0, [], 0
                if value[:1] == b">":
                    out(True)
                    seg, title, at, held, size = seg + 1, (value[1:].decode().split(None, 1) or [""])[0], 0, [], 0
                else:
                    held.append(value)
                    size += len(value)
                    if size >= PIECE:
                        out(False)
            if made[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)
                made = [[] for _ in schema]
        if here is not None:
            out(True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return lines.select("path", "split", F.col("value").cast("binary").alias("value")).mapInArrow(run, "path string, split long, seg long, title string, at long, dna string")


def lines(spark: SparkSession, path) -> DataFrame:
    """(path, split, value): the lines of text files and the place where their split of the file begins."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def scan(x: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """(path, record, seq, start, dna): pieces of records with their place in them, from lines(). A record begins with a line that begins
    with >, its id is the first word there; record tells those of one file apart.

    A split of a file is read by one task from line to line, nothing is shuffled. What stands before its first title belongs to the
    last record of the splits before it: one row for each split has the last title, the bases after it and those before the first
    one, and a window over these rows carries id and place on. So the files are read twice, and no row holds a record. The
    rows are as many as the splits that the driver lists anyway, so they are broadcast. Compressed files are one split.
    names maps ids to new ones and leaves other records out."""
    p = pieces(x)
    seg = p.groupBy("path", "split", "seg").agg(F.sum(F.length("dna")).alias("n"), F.max("title").alias("title"))
    s = seg.groupBy("path", "split").agg(F.sum(F.when(F.col("seg") == 0, F.col("n"))).alias("head"), F.max(F.when(F.col("seg") > 0, F.struct("seg", "title", "n"))).alias("last"))
    upto = Window.partitionBy("path").orderBy("split")
    s = s.withColumn("cum", F.sum(F.coalesce("head", F.lit(0))).over(upto)).withColumn("last", F.when(F.col("last").isNotNull(), F.struct("split", "last", "cum")))
    s = s.withColumn("from", F.last("last", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))).withColumn("cum", F.coalesce(F.lag("cum").over(upto), F.lit(0)))
    carry = s.select("path", "split", F.col("from.last.title").alias("_title"), F.struct(F.col("from.split").alias("split"), F.col("from.last.seg").alias("seg")).alias("_record"), (F.col("from.last.n") + F.col("cum") - F.col("from.cum")).alias("_start"))
    begun = F.col("seg") > 0
    y = p.join(F.broadcast(carry), ["path", "split"]).select("path", F.when(begun, F.struct("split", "seg")).otherwise(F.col("_record")).alias("record"), F.when(begun, F.col("title")).otherwise(F.col("_title")).alias("seq"), F.when(begun, F.col("at")).otherwise(F.col("at") + F.col("_start")).alias("start"), "dna").where("seq is not null")
    if names is not None:
        table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
        y = y.withColumn("seq", F.try_element_at(table, F.col("seq"))).where("seq is not null")
    return y


def read(spark: SparkSession, path, names: dict[str, str] | None = None) -> DataFrame:
    """(seq, dna, path): one row for each record, for records that fit in a row; read_blocks() has no such bound."""
    return whole(scan(lines(spark, path), names))


def whole(scanned: DataFrame) -> DataFrame:
    x = scanned.groupBy("path", "record", "seq").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start", "dna")))["dna"], "").alias("dna"))
    return x.select("seq", "dna", "path")


def lengths(scanned: DataFrame) -> DataFrame:
    """(seq, length, path) of each record; no bases are moved."""
    return scanned.groupBy("path", "record", "seq").agg(F.sum(F.length("dna")).alias("length")).select("seq", "length", "path")


def read_blocks(spark: SparkSession, path, size: int = BLOCK, overlap: int = 0, names: dict[str, str] | None = None) -> DataFrame:
    """(seq, block, offset, dna, path): what blocks() gives, straight from the files."""
    return aligned(scan(lines(spark, path), names), size, overlap)


def aligned(scanned: DataFrame, size: int = BLOCK, overlap: int = 0) -> DataFrame:
    """Blocks of `size` bases from the pieces of scan(), each with the first `overlap` bases of the next one."""
    end, at = F.col("start") + F.length("dna"), lambda p: F.expr(f"({p}) div {size}")
    x = scanned.withColumn("_end", end).where(F.col("_end") > F.col("start"))
    x = x.withColumn("block", F.explode(F.sequence(F.greatest(at(f"start - {overlap}"), F.lit(0)), at("_end - 1"))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("_end"), (F.col("block") + 1) * size + overlap)
    x = x.where(lo < hi).select("path", "record", "seq", "block", lo.alias("lo"), F.substr("dna", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("dna"))
    x = x.groupBy("path", "record", "seq", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("lo", "dna")))["dna"], "").alias("dna"))  # one block's bases
    # a block that only the overlap of the one before reaches into has bases of its own, so none is made up here
    return x.select("seq", F.col("block").cast("int").alias("block"), (F.col("block") * size).alias("offset"), "dna", "path")


def blocks(sequence: DataFrame, size: int = BLOCK, overlap: int = 0) -> DataFrame:
    """(seq, block, offset, dna) pieces, so that a long contig is spread over tasks; each has the first `overlap` bases of the next one
    too. One pass of a pattern cuts them: substrings by place would walk the string again for each piece."""
    pieces = F.regexp_extract_all("dna", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    if overlap:
        pieces = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(pieces, i + 1), 1, overlap), F.lit(""))))
    x = sequence.select("seq", F.posexplode(pieces).alias("block", "dna"))
    return x.select("seq", "block", (F.col("block").cast("long") * size).alias("offset"), "dna")


def cut(places: DataFrame, pieces: DataFrame, keys: tuple[str, ...], size: int = SLICE) -> DataFrame:
    """(keys, dna): the bases of each key's distinct half-open places (keys, seq, start, stop) in genomic order, from blocks() of that size.

    A place is dealt to the blocks it touches, so no row carries a whole sequence. Places without bases give ''; those before or
    beyond the sequence are clipped."""
    a, b = F.greatest("start", F.lit(0)).cast("long"), F.greatest(F.col("stop") - 1, F.col("start"), F.lit(0)).cast("long")
    block = lambda p: F.floor(p / F.lit(size)).cast("int")
    each = places.select(*keys, "seq", "start", "stop").distinct().withColumn("block", F.explode(F.sequence(block(a), block(b))))
    x = each.join(pieces.select("seq", "block", "offset", "dna"), ["seq", "block"], "left")
    lo, hi = F.greatest("start", "offset"), F.least("stop", F.col("offset") + size)
    piece = F.coalesce(F.when(lo < hi, F.substr("dna", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))), F.lit(""))
    x = x.select(*keys, F.struct("start", "stop", "block", piece.alias("dna")).alias("p"))
    return x.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("p"))["dna"], "").alias("dna"))  # one key's places


def cut_lists(rows: DataFrame, sequence: DataFrame, size: int = SLICE) -> DataFrame:
    """rows (seq, places and others) of the sequences in sequence(seq, dna), with `found` instead of places, an array of (kind, start, stop):
    (kind, start, stop, block, dna) for each block that a place touches, in any order. Bases are those that cut() gives.

    A row goes to each block that its places touch, with these places alone. Rows of one block, which most are, are whole then; only
    the others are put together by a shuffle."""
    cols = [c for c in rows.columns if c != "places"]
    block = lambda p: F.floor(p / F.lit(size)).cast("int")
    first = lambda v: block(F.greatest(v["start"], F.lit(0)).cast("long"))
    last = lambda v: block(F.greatest(v["stop"] - 1, v["start"], F.lit(0)).cast("long"))
    x = rows.withColumn("_blocks", F.array_distinct(F.flatten(F.transform("places", lambda v: F.sequence(first(v), last(v))))))
    x = x.select(*cols, "places", F.size("_blocks").alias("_n"), F.explode("_blocks").alias("block"))
    x = x.withColumn("places", F.filter("places", lambda v: (first(v) <= F.col("block")) & (last(v) >= F.col("block"))))
    # by bytes, as letters by place would be walked to from the block's first one for each piece; only a block with others than ASCII needs that
    plain = F.octet_length("dna") == F.length("dna")
    pieces = blocks(sequence, size).withColumns({"raw": F.when(plain, F.col("dna").cast("binary")), "dna": F.when(~plain, F.col("dna"))})
    x = x.join(pieces.hint("merge"), ["seq", "block"], "left")

    def piece(v: Column) -> Column:
        lo, hi = F.greatest(v["start"], F.col("offset")), F.least(v["stop"], F.col("offset") + size)
        of = lambda c: F.substr(c, (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")).cast("string")
        dna = F.coalesce(F.when(lo < hi, F.coalesce(of(F.col("raw")), of(F.col("dna")))), F.lit(""))
        return F.struct(v["kind"].alias("kind"), v["start"].alias("start"), v["stop"].alias("stop"), F.col("block").alias("block"), dna.alias("dna"))

    x = written(x.select(*cols, "_n", F.col("offset").isNotNull().alias("_there"), F.transform("places", piece).alias("found")), "cut")
    # beyond a sequence's end there is no block, so only then is the sequence itself looked for
    x = x.where("_there").unionByName(x.where("not _there").join(sequence.select("seq"), "seq", "left_semi").select(*x.columns))
    many = x.where("_n > 1").groupBy(*cols).agg(F.flatten(F.collect_list("found")).alias("all")).withColumn("found", F.array_distinct("all"))
    many = many.select(*cols, "found", F.explode(F.sequence(F.lit(1), (F.size("all") / F.size("found")).cast("int")))).drop("col")  # equal rows stay
    return x.where("_n = 1").select(*cols, "found").unionByName(many)


def gather(places: DataFrame, pieces: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """(seq, at, bases): the n bases from each distinct place (seq, at) on, fewer at the sequence's end, from blocks() of that size with an
    overlap of n - 1. The places of a block meet it as one list, as long as the block at most, and are looked up in one pass."""
    x = places.select("seq", F.col("at").cast("long").alias("at")).where("at >= 0").withColumn("block", F.floor(F.col("at") / F.lit(size)).cast("int"))
    x = x.groupBy("seq", "block").agg(F.collect_set((F.col("at") % size).cast("int")).alias("at"))
    x = x.join(pieces.select("seq", "block", "offset", F.col("dna").cast("binary").alias("dna")), ["seq", "block"]).select("seq", "offset", "at", "dna")
    schema = pa.schema([("seq", pa.string()), ("at", pa.int64()), ("bases", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                dna, at = np.frombuffer(b.column(3)[k].as_py(), "u1"), b.column(2)[k].values.to_numpy()
                at = at[at < len(dna)]
                size_of = np.minimum(n, len(dna) - at)
                ends = np.r_[0, np.cumsum(size_of)].astype("i4")
                data = dna[np.repeat(at - ends[:-1], size_of) + np.arange(ends[-1])]
                bases = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
                yield pa.record_batch([pa.array([b.column(0)[k].as_py()] * len(at), pa.string()), pa.array(at.astype("i8") + b.column(1)[k].as_py()), bases], schema=schema)

    return x.mapInArrow(run, "seq string, at long, bases string")


def bases_at(places: DataFrame, pieces: DataFrame, at: dict[str, Column], n: int, size: int = BLOCK) -> DataFrame:
    """places with a column for each entry of at: the n bases from there on, '' where no sequence is. All places are gathered together; only
    the bases found are joined back, never a block, and by a sort: their files are small beside the rows, so Spark would broadcast millions of them."""
    wanted = None
    for c in at.values():
        x = places.select("seq", c.cast("long").alias("at"))
        wanted = x if wanted is None else wanted.unionByName(x)
    found = written(gather(wanted, pieces, n, size), "bases")
    out = places
    for name, c in at.items():
        out = out.withColumn("_at", c.cast("long")).join(found.select("seq", F.col("at").alias("_at"), F.col("bases").alias(name)).hint("merge"), ["seq", "_at"], "left").drop("_at").withColumn(name, F.coalesce(name, F.lit("")))
    return out.select(*places.columns, *at)


def longest(sequence: DataFrame, n: int) -> DataFrame:
    """The n longest records, ties by name."""
    return sequence.select("seq", F.length("dna").alias("length")).orderBy(F.desc("length"), "seq").limit(n)


def write(sequence: DataFrame, path: str, width: int = 60) -> None:
    """FASTA files of sequence(seq, dna and perhaps title, the rest of the first line)."""
    body = F.regexp_replace("dna", f"(.{{{width}}})(?=.)", "$1\n")
    title = F.concat_ws(" ", "seq", "title") if "title" in sequence.columns else F.col("seq")
    sequence.orderBy("seq").select(F.concat(F.lit(">"), title, F.lit("\n"), body)).write.mode("overwrite").text(path)


def transcripts(features: DataFrame, sequence: DataFrame, types=("CDS",)) -> DataFrame:
    """(seq, dna): the spliced sequence of each transcript's parts; those with other letters than A, C, G, T are left out."""
    from ..functions.dna import reverse_complement

    p = features.where(F.col("type").isin(*types)).select("parent", "strand", "seq", "start", "stop")
    p = p.withColumn("_seq", F.col("seq"))
    x = cut(p, blocks(sequence, SLICE), ("parent", "_seq", "strand"))
    x = x.select(F.col("parent").alias("seq"), F.when(F.col("strand") == "-", reverse_complement(F.col("dna"))).otherwise(F.col("dna")).alias("dna"))
    return x.where(F.col("dna").rlike("^[ACGTacgt]+$"))
