"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every row gets the SHA-256 of its normalised text (white-space runs become one space; null counts as empty), a second
independent 64-bit hash and the length; texts are taken as equal only where all three agree (320 bits and a length, which a
comparison of the texts themselves would not improve on at any table size). Each map task sorts its digests and keeps one row for
each, with the smallest identifier and the count; the tasks' outputs form `runs` runs. In each round of a binomial tree of
fan-in 2**FAN_BITS the runs whose numbers differ in the next bits send their rows to the one with these bits zero. There they are
sorted by digest, neighbours are merged and the smallest verified identifier stays. Digests that have only one row in all runs
are done then; only winners of several rows go down the same tree again. No merge sees more than 2**FAN_BITS rows of a digest and
run, and a text that a third of all rows share is spread over all runs, whose number follows that of the rows.

Edge cases: a null text equals the empty text; null doc_ids come last (keep_id is null only if every id of the group is);
of repeated rows with the same doc_id and text exactly one is kept, the first in the order of the table's partitions; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS, fresh, materialize, release

RUNS, FAN_BITS, ROWS_PER_RUN = 64, 3, 1 << 20
KEY = ["text_sha256", "_x", "_n"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, _x, _n, _row, _part): one row for each row of docs, in the order of its partitions."""
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    return rows.select("doc_id", F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"), F.xxhash64("_t").alias("_x"), F.octet_length("_t").alias("_n"), F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_part"))


def run_bits(rows: int) -> int:
    """Bits of the number of runs: a multiple of FAN_BITS, at least RUNS runs and no more than ROWS_PER_RUN rows in each."""
    bits = FAN_BITS
    while (1 << bits) < max(RUNS, rows // ROWS_PER_RUN):
        bits += FAN_BITS
    return bits


def classes(digests: DataFrame) -> DataFrame:
    """digests with keep_id, keep_row and group_size of its class. digests should be a written table: it is read twice."""
    top = run_bits(digests.count())
    own_run = F.pmod(F.col("_part"), F.lit(1 << top))
    first = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    merged = lambda x, best, n: x.groupBy("_run", *KEY).agg(F.min(best).alias("_first"), n.alias("_count"))  # noqa: E731  sorts by run and digest, in each task before and after the exchange
    level = materialize(merged(digests.withColumn("_run", own_run), first, F.count(F.lit(1))), "runs0", True)
    levels, bits = [], 0
    up = lambda b: F.col("_run").bitwiseAND(F.lit(~((1 << b) - 1)))
    while bits < top:
        levels.append((bits, level))
        bits += FAN_BITS
        level = materialize(merged(level.withColumn("_run", up(bits)), "_first", F.sum("_count")), f"runs{bits}", True)
    won = level.where("_count > 1")  # of all other digests the one row stays
    for bits, below in reversed(levels):
        down = below.select(*KEY, F.col("_run").alias("_own"), up(bits + FAN_BITS).alias("_run"))
        won = down.join(won, ["_run", *KEY]).select(*KEY, F.col("_own").alias("_run"), "_first", "_count")
    won = materialize(won, "winners", True)
    release(level, *(x for _, x in levels))
    out = digests.withColumn("_run", own_run).join(won, ["_run", *KEY], "left")
    return out.select("doc_id", "text_sha256", "_row", F.when(F.col("_count").isNull(), F.col("doc_id")).otherwise(F.col("_first.id")).alias("keep_id"), F.coalesce("_first.row", "_row").alias("keep_row"), F.coalesce("_count", F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = classes(materialize(digest_rows(docs, id_col, text_col), "digests"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own columns: the first of each group of equal texts.

    Of rows with one id and text the one with the smallest hash of all its columns stays (any one if all are equal)."""
    digests = materialize(digest_rows(docs, id_col, text_col), "digests")
    kept = materialize(classes(digests).where(F.col("_row") == F.col("keep_row")).select("doc_id", "text_sha256"), "kept", True)
    again = digests.groupBy("doc_id", *KEY).count().where("count > 1").limit(1).count()  # repeated rows with one id
    release(digests)
    own, tag, copy, ident, text = docs.columns, *(fresh(docs, c) for c in ("_kept_sha", "_kept_copy", "_kept_id", "_kept_text"))
    keyed = docs.withColumn(tag, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    mine = kept.select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(text))
    out = keyed.join(mine, F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(tag) == F.col(text)), "left_semi")
    if again:
        whole = F.sha2(F.to_json(F.struct(*own)), 256)
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(id_col, tag).orderBy(whole))).where(F.col(copy) == 1)
    return out.select(*own)
