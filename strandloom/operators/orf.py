"""Joining neighbouring gene fragments whose coding sequences together make one complete reading frame."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna as D
from ..sources import fasta
from .hierarchy import cds_phase
from .sweep import Take, running
from .tables import written

BLOCK, HALO = 1024, 64  # genes of a block, and of those after it that a task sees at first
OPEN = "open"
Gene = namedtuple("Gene", ("strand", "gene", "start", "stop", "cds", "donor", "acceptor"))
GROWTH = 1.3  # a chain of over two genes must be this much longer than its longest member


def gene_table(df: DataFrame, sequence: DataFrame) -> DataFrame:
    """(seq, strand, gene, start, stop, cds, donor, acceptor) from a feature tree and sequence(seq, dna).

    donor and acceptor are the two bases at the gene's ends that a junction with the neighbour is judged by."""
    m = df.where("type = 'mRNA'").select(F.col("id").alias("parent"), F.col("parent").alias("gene"))
    g = df.where("type = 'gene'").select("seq", "strand", F.col("id").alias("gene"), "start", "stop")
    # joined by sorts: what a plan knows of the sizes comes from the files, which may be far smaller than the rows made of them
    parts = df.where("type = 'CDS'").select("parent", "start", "stop").join(m.hint("merge"), "parent")
    parts = parts.groupBy("gene").agg(F.collect_set(F.struct("start", "stop")).alias("_cds"))  # one gene's places
    plus, zero = F.col("strand") == "+", F.lit(0)
    two = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.greatest(at, zero).alias("start"), (F.greatest(at, zero) + 2).alias("stop"))
    ends = F.array(two("donor", F.when(plus, F.col("stop") - 1).otherwise(F.col("stop") - 2)), two("acceptor", F.when(plus, F.col("start") - 2).otherwise(F.col("start") + 1)))
    cds = F.transform("_cds", lambda v: F.struct(F.lit("cds").alias("kind"), v["start"].alias("start"), v["stop"].alias("stop")))
    x = g.join(parts.hint("merge"), "gene", "left").select("seq", "strand", "gene", "start", "stop", F.when(F.col("_cds").isNull(), ends).otherwise(F.concat(ends, cds)).alias("places"))
    x = fasta.cut_lists(x, sequence)
    read = lambda k: F.array_join(F.transform(F.array_sort(F.filter("found", lambda v: v["kind"] == k)), lambda v: v["dna"]), "")
    one = lambda k: F.upper(F.when(plus, read(k)).otherwise(D.reverse_complement(read(k)))).alias(k)
    return x.select("seq", "strand", "gene", "start", "stop", *(one(k) for k in ("cds", "donor", "acceptor")))


def complete(nuc: str) -> bool:
    ends = [nuc[i : i + 3] in D.STOPS for i in range(0, len(nuc) - 2, 3)]
    return len(nuc) >= 6 and len(nuc) % 3 == 0 and nuc[:3] == "ATG" and ends[-1] and not any(ends[:-1])


def _chain(rows: Sequence, i: int, whole: Sequence[bool]) -> tuple[int, str, int] | str | None:
    """(last member, joined sequence, bases cut at the last junction) of the first chain from i that is a complete frame; OPEN if the
    rows end before that is decided."""
    before = rows[i]
    joined, read, longest = before.cds, 0, len(before.cds or "")
    if not joined or whole[i]:
        return (i, joined, 0) if joined else None
    if not joined.startswith("ATG"[: len(joined)]):
        return None
    for j in range(i + 1, len(rows)):
        own = rows[j]
        # a stop codon in what is joined so far stays inside every longer chain
        end = len(joined) - len(joined) % 3
        if not own.cds or any(joined[k : k + 3] in D.STOPS for k in range(read, end, 3)):
            return None
        read = end
        forward = own.strand == "+"
        gap = own.start - before.stop if forward else before.start - own.stop
        donor, acceptor = (before.donor, own.acceptor) if forward else (own.donor, before.acceptor)
        free = abs(gap) <= 2 and donor in ("GT", "GC", "AT") and acceptor == "AG"
        longest = max(longest, len(own.cds))
        for cut in (0, 1, 2) if free else (0,):
            made = joined + own.cds[cut:]
            if len(own.cds) > cut and complete(made):
                if any(whole[i + 1 : j + 1]):
                    return None
                if len(made) > longest and (j - i < 2 or len(made) >= GROWTH * longest):
                    return j, made, cut
        joined, before = joined + own.cds, own
    return OPEN


def _edges(t: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """The first rows of the runs of equal values, which are not null."""
    new = np.ones(t.num_rows, bool)
    if t.num_rows > 1:
        new[1:] = False
        for c in by:
            v = t[c].combine_chunks()
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


class _Genes(Sequence):
    """The rows of one block from columns, made where they are asked for."""

    def __init__(self, columns: dict, lo: int, hi: int):
        self.columns, self.lo, self.hi = columns, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        at = self.lo + k % len(self)
        return Gene(*(self.columns[c][at] for c in Gene._fields))


class _Whole:
    """complete() of a block's genes, worked out where it is asked for."""

    def __init__(self, cds: list, lo: int):
        self.cds, self.lo = cds, lo

    def __getitem__(self, k):
        return [complete(v) for v in self.cds[self.lo + k.start : self.lo + k.stop]] if isinstance(k, slice) else complete(self.cds[self.lo + k])


def _decided(t: pa.Table, edges: np.ndarray, block: int, again: bool) -> Iterator[tuple]:
    """(seq, strand, members, cut, cds, open) of the chains that begin in blocks, edges being their first rows."""
    cds, idx = t["cds"], t["idx"].to_numpy()
    # what begins with neither ATG nor a part of it begins no chain, and no complete gene either
    may = pc.fill_null(pc.or_(pc.starts_with(cds, "ATG"), pc.less(pc.utf8_length(cds), 3)), False).to_numpy() & (idx // block == t["part"].to_numpy())
    if again:
        may &= t["tried"].to_numpy()
    begins = np.flatnonzero(may)
    if not len(begins):
        return
    lists = {c: t[c].to_numpy() for c in Gene._fields}
    seq, beyond = t["seq"], t["beyond"].to_numpy()
    ends = np.append(edges[edges < t.num_rows], t.num_rows)
    for at, run in zip(begins.tolist(), (np.searchsorted(ends, begins, "right") - 1).tolist(), strict=True):
        lo, hi = int(ends[run]), int(ends[run + 1])
        rows, i = _Genes(lists, lo, hi), at - lo
        made = _chain(rows, i, _Whole(lists["cds"], lo))
        if made == OPEN:
            if beyond[hi - 1]:
                yield seq[at].as_py(), lists["strand"][at], None, None, None, int(idx[at])
        elif made:
            j, joined, cut = made
            yield seq[at].as_py(), lists["strand"][at], lists["gene"][at : lo + j + 1].tolist(), cut, joined, None


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def orf_chains(genes: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(seq, strand, members, cut, cds): for each gene the chain of it and its next neighbours that forms a complete frame.

    Genes are numbered along each sequence and strand in reading order by a sweep, and dealt over blocks with the first `halo` genes of
    what follows. A stop codon in frame or a gene without bases ends a chain, so most are decided there. Those still open at the end of
    what their block holds are tried again with a halo twice as wide, in rounds, until none is open: rounds follow the logarithm of the
    longest chain, and a task holds a block and its halo at a time, however many genes a sequence has."""
    at = ["seq", "strand"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    x = running(genes, at, [F.col("start"), F.col("stop"), F.col("gene")], "start", {"_before": Take("sum", one), "_after": Take("sum", one, ahead=True)})
    plus, before, after = F.col("strand") == "+", F.coalesce("_before", none), F.coalesce("_after", none)
    x = x.withColumns({"idx": F.when(plus, before).otherwise(after), "beyond": F.when(plus, after).otherwise(before)}).drop("_before", "_after")
    x = written(x.where("seq is not null and strand is not null"), "genes")  # numbered once, read in every round
    cols = ["seq", "strand", "part", "idx", "beyond", "gene", "start", "stop", "cds", "donor", "acceptor"]
    ddl = "seq string, strand string, members array<string>, cut int, cds string, open long"
    schema = pa.schema([("seq", pa.string()), ("strand", pa.string()), ("members", pa.list_(pa.string())), ("cut", pa.int32()), ("cds", pa.string()), ("open", pa.int64())])
    found, begun, wide = None, None, halo
    while True:
        again = begun is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by block and place; a batch and the block that it continues are held at a time. Only genes that may begin
            a chain are looked at one by one."""
            held = None
            for b in batches:
                t = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)]).combine_chunks()
                edges = _edges(t, ("seq", "strand", "part"))
                held = t.slice(edges[-1])  # the last block may go on
                if out := list(_decided(t.slice(0, edges[-1]), edges, block, again)):
                    yield _batch(out, schema)
            if held is not None and (out := list(_decided(held, np.array([0, held.num_rows]), block, again))):
                yield _batch(out, schema)

        y = x if begun is None else x.join(begun, [*at, "idx"], "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
        first = F.greatest(F.floor((F.col("idx") - wide) / F.lit(block)), none)
        y = y.withColumn("part", F.explode(F.sequence(first, F.floor(F.col("idx") / F.lit(block)))))
        if begun is not None:
            y = y.join(begun.select(*at, F.floor(F.col("idx") / F.lit(block)).alias("part")).distinct(), [*at, "part"], "left_semi")
        y = y.where(F.col("idx") < (F.col("part") + 1) * block + wide).select(*cols, *(["tried"] if again else []))
        made = written(y.repartition(*at, "part").sortWithinPartitions(*at, "part", "idx").mapInArrow(run, ddl), "chains")
        found = made if found is None else found.unionByName(made)
        begun = made.where("open is not null").select(*at, F.col("open").alias("idx"), F.lit(True).alias("tried"))
        if begun.isEmpty():
            return found.where("members is not null").drop("open")
        wide *= 2


def candidates(genes: DataFrame) -> DataFrame:
    """(key, seq, strand, members, protein): proteins of complete single genes and of joined ones."""
    from ..functions.attributes import merged_key

    x = orf_chains(genes)
    return x.select(merged_key(F.col("seq"), F.col("members"), F.col("strand")).alias("key"), "seq", "strand", "members", D.clean_protein(D.translate(F.col("cds"))).alias("protein"))


def apply_merges(df: DataFrame, merges: DataFrame, keep_unmerged: bool = True) -> DataFrame:
    """A feature tree in which each accepted chain (members, two or more) is one gene concat_<members joined by _> with one mRNA and all parts.

    A gene in several chains goes to the one with most members, then to the one whose first member comes first by name."""
    m = merges.where(F.size("members") > 1).select(F.concat(F.lit("concat_"), F.array_join("members", "_")).alias("new"), "members")
    each = m.select("new", F.size("members").alias("n"), F.explode("members").alias("gene"))
    each = each.withColumn("_k", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "new"))).where("_k = 1")
    full = each.groupBy("new", "n").agg(F.count(F.lit(1)).alias("have")).where("have = n").select("new")
    each = each.join(full, "new", "left_semi").select("new", "gene")
    old_m = df.where("type = 'mRNA'").select(F.col("id").alias("mrna"), F.col("parent").alias("gene"))
    of_m = old_m.join(each, "gene").select("mrna", "new")
    parts = df.where("type not in ('gene', 'mRNA')").join(of_m, F.col("parent") == F.col("mrna")).withColumn("parent", F.concat("new", F.lit(".t1")))
    genes = df.where("type = 'gene'").join(each.withColumnRenamed("gene", "id"), "id").groupBy("new", "seq", "strand").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("row").alias("row"))
    new_g = genes.select(F.col("new").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("gene").alias("type"), "seq", "strand", "start", "stop", "row")
    new_m = genes.select(F.concat("new", F.lit(".t1")).alias("id"), F.col("new").alias("parent"), F.lit("mRNA").alias("type"), "seq", "strand", "start", "stop", "row")
    cols = ["id", "parent", "type", "seq", "strand", "start", "stop", "row"]
    out = new_g.unionByName(new_m).unionByName(parts.select(*cols))
    if keep_unmerged:
        gone = each.select(F.col("gene").alias("id")).unionByName(of_m.select(F.col("mrna").alias("id")))
        rest = df.join(gone, "id", "left_anti").join(of_m.select(F.col("mrna").alias("parent")), "parent", "left_anti")
        out = out.unionByName(rest.select(*cols))
    phased = cds_phase(out.where("type = 'CDS'"))
    return out.where("type <> 'CDS'").withColumn("phase", F.lit(None).cast("int")).unionByName(phased)
