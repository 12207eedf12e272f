"""N-gram Jaccard join: a size-aware heavy-light join with exact verification.

A document's set holds the hashes of its distinct word shingles. Two sets link when den * |x & y| >= num * |x | y|. Sets are
ordered by how frequent a shingle is (counted over all documents in SLOTS slots, in steps of a factor of 1.4) and then by hash, so
rare shingles come first. If two sets link, the prefixes that leave out all but the last ceil(num * n / den) - k elements of
each share at least k elements.

* Light sets (n below the boundary) enumerate all subsets of fixed size 2 of their prefix for k = 2.
* Heavy sets are found by scanning inverted lists of the prefix for k = 1; light sets large enough to link with heavy ones
  are in these lists too.
* The boundary is the one with the smallest cost, from the histogram of set sizes: subsets made against list entries made
  and scanned.

Equal sets are one node. Within a list not all pairs are formed: each node is paired with the list's most central node (the
one with the fewest rare shingles, such as the original of a group of near copies) and with its neighbour. A pair is dropped
if the sizes differ too much or if their parity signatures differ in more places than the sets can (a lower bound of the
symmetric difference, so exact); the rest are verified on the full sets. Then components are found, and in every list of
more than three nodes (of more than two, if its shingle is frequent) that still spans several components, all pairs across components are compared by signature, in blocks
of BLOCK nodes, and the survivors verified. So no link between different components is lost, and pairs within a group of
near copies are not multiplied. Lists of frequent shingles (a slot count over twice the mean) are joined with their centre
rather than gathered, so a shingle that a third of all documents has is dealt over many tasks; the other lists are no
longer than their slot's count.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; with fewer words than a shingle
the whole sequence is the one element; rows with equal texts, repeated ids included, are in one component; a row with a null
id takes its group's component_id (null if it has no other row); rows with one id and different texts are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, fresh, materialize, release
from .components import components
from .shingles import mix, shingle_set

WORDS, NUM, DEN = 4, 85, 100
SLOT_BITS, PARTS = 22, 64
MAX_BOUNDARY, SCAN_COST = 256, 2.0
BLOCK = 512
BROADCAST_ROWS, PART_ROWS = 500_000, 4_000_000


def prefix_length(n: np.ndarray | int, k: int, num: int = NUM, den: int = DEN):
    """Length of the prefix in which two linking sets share k elements."""
    return np.minimum(n, n - (-(-num * n // den)) + k)


def signature(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements by the lowest bits of their hash; at least twice as many bits as elements, so that
    few differences cancel out."""
    bits = 1024
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sig: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(sig, np.uint64)
    while len(a) * 8 > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


def may_link(n1: int, sig1: bytes, n2: int, sig2: bytes, num: int, den: int) -> bool:
    size = min(len(sig1), len(sig2))
    return int(np.bitwise_count(fold(sig1, size) ^ fold(sig2, size)).sum()) * (den + num) <= (n1 + n2) * (den - num)


def links(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both) and both > 0


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128-bit key of a set (sorted hashes), as two signed numbers: the first one meets in lists, both tell sets apart."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())


# --- pass 1: one row per document, and slot counts -----------------------------------------------------------------------

FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("sig", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
FIRST_DDL = "doc_id long, n long, key long, key2 long, sig binary, part int, counts binary"


def first_pass(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << SLOT_BITS, np.uint32), [], 0

        def add() -> None:
            nonlocal size
            total[:] += np.bincount(np.concatenate(held), minlength=1 << SLOT_BITS).astype(np.uint32)
            held.clear()
            size = 0

        for b in batches:
            ids, ns, keys, more, sigs = b.column(0), [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                ns.append(len(s))
                k1, k2 = set_keys(s) if len(s) else (None, None)
                keys.append(k1)
                more.append(k2)
                sigs.append(signature(s) if len(s) else None)
                if len(s):
                    held.append((s >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
                    size += len(s)
                    if size > 1 << 21:
                        add()
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(more, pa.int64()), pa.array(sigs, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=FIRST)
        if size:
            add()
        for k, part in enumerate(np.split(total, PARTS)):
            if part.any():
                one = [pa.nulls(1).cast(FIRST.field(i).type) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], schema=FIRST)

    return docs.mapInArrow(run, FIRST_DDL)


def slot_ranks(first: DataFrame, total: int) -> np.ndarray:
    """Frequency rank of each slot in steps of half a power of two; 0: up to twice the mean. 2**SLOT_BITS bytes, at any size of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros((1 << SLOT_BITS) // PARTS, np.uint64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.floor(2 * np.log2(counts + np.uint64(1))).astype(np.uint8).tobytes()], pa.binary())], names=["part", "ranks"])

        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, counts = part, np.zeros_like(counts)
                counts += np.frombuffer(zlib.decompress(blob), np.uint32)
        if now is not None:
            yield out()

    parts = first.where("part is not null").select("part", "counts").repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(run, "part int, ranks binary").collect()
    ranks = np.zeros((PARTS, (1 << SLOT_BITS) // PARTS), np.int16)
    for r in parts:
        ranks[r.part] = np.frombuffer(r.ranks, np.uint8)
    usual = int(2 * np.log2(2 * max(total / (1 << SLOT_BITS), 1) + 1))
    return np.maximum(ranks.ravel() - usual, 0).astype(np.uint8)


def boundary(sizes: dict[int, int], num: int = NUM, den: int = DEN) -> int:
    """The size below which sets are light, by cost; sizes: number of sets of each size."""
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 1
    c = np.array([sizes[k] for k in n.tolist()], float)
    p1, p2 = prefix_length(n, 1, num, den), prefix_length(n, 2, num, den)
    cost = [(c * (p2 * (p2 - 1) / 2))[n < x].sum() + (c * p1)[den * n >= num * x].sum() * (1 + SCAN_COST) for x in range(1, MAX_BOUNDARY + 1)]
    return int(np.argmin(cost)) + 1


# --- pass 2: entries of lists --------------------------------------------------------------------------------------------

ENTRY = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("rare", pa.float32()), ("often", pa.bool_())])
ENTRY_DDL = "token long, key long, n int, rare float, often boolean"
SEEN = 1 << 16


def set_entries(s: np.ndarray, ranks: np.ndarray, bound: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens, whether each is frequent, share of rare elements) of one set."""
    n = len(s)
    r = ranks[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    order = np.lexsort((s, r))
    tokens, often = [], []
    if n < bound:
        top = order[: prefix_length(n, 2, num, den)]
        i, j = np.triu_indices(len(top), 1)
        tokens.append(mix(s[top[i]] * np.uint64(0xD6E8FEB86659FD93) + s[top[j]] + np.uint64(1)))
        often.append(r[top[i]] > 0)  # the first is the rarer one
    if den * n >= num * bound:
        top = order[: prefix_length(n, 1, num, den)]
        tokens.append(s[top])
        often.append(r[top] > 0)
    return np.concatenate(tokens), np.concatenate(often), float((r == 0).mean())


def entries(docs: DataFrame, ranks: np.ndarray, bound: int, words: int, num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 2**SLOT_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                if not len(s) or (key := set_keys(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                tokens, often, rare = set_entries(s, shared.value, bound, num, den)
                for col, v in zip(out, (tokens.view(np.int64), np.full(len(tokens), key[0]), np.full(len(tokens), len(s), np.int32), np.full(len(tokens), rare, np.float32), often), strict=True):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(out, ENTRY, strict=True)], schema=ENTRY)

    return docs.mapInArrow(run, ENTRY_DDL)


def scan_lists(light: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, a, b): b null: a is in a list of over three nodes; else a pair of nodes to compare. Lists come sorted."""
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def complete(t: np.ndarray, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, k, n = t[new], k[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(first, len(t)))
        head = np.repeat(first, size)
        me = np.arange(len(t))
        a = np.concatenate([head, me - 1])
        b = np.concatenate([me, me])
        ok = np.concatenate([me > head, me > head + 1])
        a, b = a[ok], b[ok]
        ok = (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (k[a] != k[b])
        a, b = k[a[ok]], k[b[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        many = np.repeat(size, size) > 3
        token = np.concatenate([np.zeros(len(pairs), np.int64), t[many]])
        other = pa.array(np.concatenate([pairs[:, 1], k[many]]), mask=np.concatenate([np.zeros(len(pairs), bool), np.ones(int(many.sum()), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate([pairs[:, 0], k[many]])), other], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for b in batches:
            t, k, n = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            if cut:
                yield complete(t[:cut], k[:cut], n[:cut])
            held = [t[cut:], k[cut:], n[cut:]]
        if len(held[0]):
            yield complete(*held)

    return light.select("token", "key", F.col("n").cast("long")).mapInArrow(run, "token long, a long, b long")


# --- verification --------------------------------------------------------------------------------------------------------


def by_signature(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of keys (a, b) whose signatures allow a link, as pairs of node ids (a, b), smaller first."""
    one = nodes.select(F.col("key").alias("a"), F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("sig").alias("s1"))
    two = nodes.select(F.col("key").alias("b"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("sig").alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j, *rest = (c.to_pylist() for c in b.columns)
            ok = [may_link(*x, num, den) for x in zip(*rest, strict=True)]
            a, c = np.array(i, np.int64)[ok], np.array(j, np.int64)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], names=["a", "b"])

    both = pairs.join(one, "a").join(two, "b").select("id1", "id2", "n1", "s1", "n2", "s2")
    return both.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs of node ids (a written table) whose full sets link. Sets are made anew from the texts of these nodes alone."""
    ids = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)  # counted; above that many rows the join is shuffled
    texts = docs.join(ids, F.col("doc_id") == F.col("_node")).select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["id", "s"])

    table = texts.mapInArrow(sets, "id long, s binary").where(F.octet_length("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, x, y = (v.to_pylist() for v in b.columns)
            ok = [links(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), num, den) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(c, np.int64)[ok])], names=["a", "b"])

    table = materialize(table, "sets")
    out = pairs.join(table.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(table.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()
    out = materialize(out, "links", True)
    release(table)
    return out


def across(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes (a, b) of one list and different labels whose sizes and signatures allow a link.

    lists: token, id, n, label, sig, place (running number in the list) and len. Lists longer than BLOCK are cut into blocks
    and each pair of blocks is a task's unit, so that no more than two blocks are held at a time."""
    block = F.expr(f"place div {BLOCK}")
    last = F.expr(f"(len - 1) div {BLOCK}")
    units = lists.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    units = units.select("token", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "id", "n", "label", "sig")

    def unit(ids, n, label, sig, own, u, v) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sig])
        left, right = np.flatnonzero(own == u), np.flatnonzero(own == v)
        out, folded = [], {}
        for i in left:
            ok = right[(right > i) if u == v else slice(None)]
            ok = ok[(label[ok] != label[i]) & (np.minimum(n[ok], n[i]) * den >= np.maximum(n[ok], n[i]) * num)]
            for width in np.unique(np.minimum(size[ok], size[i])).tolist():
                of = ok[np.minimum(size[ok], size[i]) == width]
                for j in (i, *of):
                    if (j, width) not in folded:
                        folded[j, width] = fold(sig[j], width)
                diff = np.bitwise_count(np.stack([folded[j, width] for j in of]) ^ folded[i, width]).sum(axis=1, dtype=np.int64)
                out += [(int(ids[i]), int(ids[j])) for j in of[diff * (den + num) <= (n[of] + n[i]) * (den - num)]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            own, ids, n, label, sig = zip(*rows, strict=True)
            found = unit(np.array(ids), np.array(n), np.array(label), sig, np.array(own), now[1], now[2])
            a, b = np.array([p[0] for p in found], np.int64), np.array([p[1] for p in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for t, u, v, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, u, v) != now:
                    if rows:
                        yield done()
                    now, rows = (t, u, v), []
                rows.append(rest)
        if rows:
            yield done()

    return units.repartition("token", "u", "v").sortWithinPartitions("token", "u", "v").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id. Only components are given, no links and no number of links:
    pairs within a component that is connected already are not verified."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = materialize(first_pass(docs, words), "first")
    rows = first.where("part is null").select("doc_id", "n", "key", "key2", "sig")
    # a node for each distinct set (two sets with one key are two nodes); its id is its smallest doc_id
    nodes = materialize(rows.where("key is not null and doc_id is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig")), "nodes", True)
    total = rows.agg(F.sum("n")).first()[0] or 0
    sizes = {r.n: r["count"] for r in nodes.where(F.col("n") <= 2 * MAX_BOUNDARY).groupBy("n").count().collect()}  # at most 2 * MAX_BOUNDARY rows
    ranks, bound = slot_ranks(first, total), boundary(sizes, num, den)
    entry = materialize(entries(docs.where("doc_id is not null"), ranks, bound, words, num, den), "entries")

    light = entry.where("not often")
    light = light.repartition(partitions(light), "token").sortWithinPartitions("token", "n", "key")
    scanned = materialize(scan_lists(light, num, den), "scanned", True)
    often = entry.where("often").select("token", "key", "n", "rare").distinct()
    centre = often.groupBy("token").agg(F.min(F.struct("rare", "n", "key")).alias("c"), F.count(F.lit(1)).alias("len")).where("len > 1")
    fits = F.least("n", F.col("c.n")) * den >= F.greatest("n", F.col("c.n")) * num
    star = often.join(centre, "token").where(fits & (F.col("key") != F.col("c.key"))).select(F.least("key", F.col("c.key")).alias("a"), F.greatest("key", F.col("c.key")).alias("b"))
    pairs = scanned.where("b is not null").select("a", "b").unionByName(star).distinct()
    close = materialize(by_signature(pairs, nodes, num, den), "close", True)
    found = verify(close, docs, words, num, den)
    label = components(found)

    # lists that still span several components
    long_lists = scanned.where("b is null").select("token", F.col("a").alias("key")).unionByName(often.join(centre.where("len > 2").select("token"), "token", "left_semi").select("token", "key"))
    named = long_lists.join(nodes.select("key", "id", "n"), "key").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = materialize(named.select("token", "id", "n", "label"), "lists", True)
    open_lists = named.groupBy("token").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("len")).where("p <> q").select("token", "len")
    placed = numbered(named.join(open_lists, "token"))
    rest = across(placed.join(nodes.select("id", "sig"), "id"), num, den)
    rest = materialize(rest.join(close, ["a", "b"], "left_anti"), "rest", True)
    if rest.limit(1).count():
        label = components(materialize(found.unionByName(verify(rest, docs, words, num, den)), "links", True))

    class_of = nodes.join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "key2", F.coalesce("label", "id").alias("component_id"))
    known = rows.where("key is not null").join(class_of, ["key", "key2"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = known.unionByName(rows.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    out = materialize(out, "components", True)
    release(first, nodes, entry, scanned, close, named, rest)
    return out


def partitions(table: DataFrame, rows: int = PART_ROWS) -> int:
    """Shuffle partitions for a written table: the session's number, or more where they would hold over `rows` rows each."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def numbered(lists: DataFrame) -> DataFrame:
    """lists (token, id, n, label, len) with place: a number from 0 below len within the list.

    Lists up to BLOCK are one unit and need no number. Longer ones are numbered by slices of the id's hash, so that no task
    sorts a whole list: first the slices are counted, then rows are numbered within their slice."""
    from pyspark.sql import Window

    short = lists.where(F.col("len") <= BLOCK).withColumn("place", F.lit(0).cast("long"))
    slices = F.pmod(F.xxhash64("id"), F.greatest(F.expr(f"len div {BLOCK} + 1"), F.lit(1)))
    long_ones = lists.where(F.col("len") > BLOCK).withColumn("slice", slices)
    count = long_ones.groupBy("token", "slice").agg(F.count(F.lit(1)).alias("m"))
    base = count.withColumn("base", F.coalesce(F.sum("m").over(Window.partitionBy("token").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("token", "slice").orderBy("id")) - 1
    long_ones = long_ones.withColumn("k", own).join(base, ["token", "slice"]).withColumn("place", F.col("base") + F.col("k"))
    return short.unionByName(long_ones.select(*short.columns))


def keep_one(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are first (smallest id) of their component, with docs' own columns; all rows without an id stay."""
    found, name = jaccard_components(docs, words, num, den, id_col, text_col), fresh(docs, "_gone")
    gone = materialize(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone", True)
    release(found)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)  # counted; above that many rows the join is shuffled
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
