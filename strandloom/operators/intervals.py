"""Interval algebra on half-open intervals (start, stop) within groups of `keys`, by default sequence and strand.

Coordinates are 0-based and half-open everywhere; readers and writers convert (see sources.gff).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import BLOCK, Step, Take, running, steps

KEYS = ("seq", "strand")
#: Width of the bins of the range joins, in bases. Wider than most features, so that an interval falls into one or two.
BIN = 4096
#: Beyond all places.
FAR = 1 << 62


def overlap_flag(df: DataFrame, keys=KEYS, name: str = "has_overlap", width: int | None = BLOCK) -> DataFrame:
    """Marks intervals that overlap another one of their group (touching is not overlapping). One sweep in blocks, no self join."""
    x = running(df, keys, [F.col("start"), F.col("stop")], "start", {"_before": Take("max", F.col("stop")), "_after": Take("near", F.col("start"), ahead=True)}, width)
    return x.withColumn(name, F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("stop"), F.lit(False))).drop("_before", "_after")


def islands(df: DataFrame, keys=KEYS, slack: int = 0, name: str = "island", width: int | None = BLOCK) -> DataFrame:
    """Numbers the islands of each group: an interval joins the one before if it starts at most `slack` after the largest stop."""
    order = [F.col("start"), F.col("stop")]
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + slack), 1).otherwise(0)
    # of rows with one start and stop all join the first, so it does not matter which of them comes first
    x = steps(df, keys, "start", [Step(order, {"_reach": Take("max", F.col("stop"))}), Step([*order, -F.col("_opens")], {name: Take("sum", F.col("_opens"), here=True)}, {"_opens": opens})], width)
    return x.drop("_reach", "_opens")


def merge(df: DataFrame, keys=KEYS, slack: int = 0, width: int | None = BLOCK) -> DataFrame:
    """Union of intervals: keys, start, stop, n_members. slack 0 also joins intervals that touch, -1 only those that overlap."""
    return islands(df, keys, slack, width=width).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_members")).drop("island")


def gaps(merged: DataFrame, keys=KEYS, width: int | None = BLOCK) -> DataFrame:
    """Gaps between consecutive disjoint intervals of a group, such as introns between exons."""
    x = running(merged, keys, [F.col("start"), F.col("stop")], "start", {"_next": Take("near", F.col("start"), ahead=True)}, width)
    return x.select(*keys, F.col("stop").alias("start"), F.col("_next").alias("stop")).where(F.col("stop") > F.col("start"))


def uncovered(df: DataFrame, keys=KEYS, width: int | None = BLOCK) -> DataFrame:
    """gaps(merge(df)) from one sweep over the intervals as they are, sorted or not, disjoint or not, repeated or not: what starts beyond all
    stops so far ends a gap. As there, no gap begins at an interval without a stop."""
    takes = {"_reach": Take("max", F.col("stop")), "_last": Take("near", F.struct("start", "stop"))}
    x = running(df.select(*keys, "start", "stop"), keys, [F.col("start"), F.col("stop")], "start", takes, width, dealt=True)
    known = F.col("_last.stop").isNotNull() | F.coalesce(F.col("_last.start") <= F.col("_reach"), F.lit(True))
    return x.where((F.col("start") > F.col("_reach")) & known).select(*keys, F.col("_reach").alias("start"), F.col("start").alias("stop"))


def complement(df: DataFrame, domain: DataFrame, keys=KEYS, width: int | None = BLOCK) -> DataFrame:
    """What of each domain interval (keys, lo, hi; one for each group) no interval covers. width None: groups are small, such as one
    transcript's parts, and meet in a plain window with their domain."""
    if width is None:
        inner = F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.greatest("start", "lo") < F.least("stop", "hi"))  # greatest and least pass over nulls
        x = domain.select(*keys, "lo", "hi").join(df.select(*keys, "start", "stop"), [*keys], "left")
        x = x.withColumns({"_s": F.when(inner, F.greatest("start", "lo")), "_e": F.when(inner, F.least("stop", "hi"))})
        w = Window.partitionBy(*keys).orderBy("_s", "_e")
        x = x.withColumns({"_reach": F.coalesce(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), "lo"), "_end": F.coalesce(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)), "lo"), "_last": F.lead(F.lit(1)).over(w).isNull()})
        free = F.array(F.struct(F.col("_reach").alias("start"), F.col("_s").alias("stop")), F.struct(F.col("_end").alias("start"), F.when(F.col("_last"), F.col("hi")).alias("stop")))
        return x.select(*keys, F.inline(free)).where("stop > start")
    # what lies before and beyond a domain counts as covered, so one sweep has all that is left; groups without one hold no row at -FAR
    place = lambda a, z: [F.expr(a).cast("long").alias("start"), F.expr(z).cast("long").alias("stop")]
    inside, parts = domain.where("lo < hi"), df.where("start < stop")
    x = parts.select(*keys, *place("start", "stop")).unionByName(inside.select(*keys, *place(f"-{FAR}", "lo"))).unionByName(inside.select(*keys, *place("hi", f"{FAR}")))
    x = running(x, keys, [F.col("start"), F.col("stop")], "start", {"_reach": Take("max", F.col("stop")), "_first": Take("min", F.col("start"))}, width, dealt=True)
    return x.where((F.col("_first") == -FAR) & (F.col("start") > F.col("_reach"))).select(*keys, F.col("_reach").alias("start"), F.col("start").alias("stop"))


def _binned(df: DataFrame, width: int, pad: int = 0) -> DataFrame:
    first, last = F.floor((F.col("start") - pad) / F.lit(width)), F.floor((F.greatest(F.col("stop") - 1, F.col("start")) + pad) / F.lit(width))
    return df.withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def overlap_join(left: DataFrame, right: DataFrame, keys=KEYS, how: str = "overlap", width: int = BIN) -> DataFrame:
    """Pairs of intervals that overlap ("overlap") or with the right one inside the left one ("contains").

    Right columns get the prefix r_. Both sides are dealt over bins, so the join has an equality key and a long sequence is
    spread over many tasks; a pair that shares several bins is kept in the bin where its common part starts."""
    other = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns))
    b = _binned(other.withColumnRenamed("r_start", "start").withColumnRenamed("r_stop", "stop"), width).withColumnRenamed("start", "r_start").withColumnRenamed("stop", "r_stop")
    pairs = _binned(left, width).join(b, [*keys, "_bin"])
    once = F.col("_bin") == F.floor(F.greatest("start", "r_start") / F.lit(width))
    test = (F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop"))
    if how == "contains":
        test = (F.col("r_start") >= F.col("start")) & (F.col("r_stop") <= F.col("stop"))
    return pairs.where(once & test).drop("_bin")


def overlap_bases(left: DataFrame, right: DataFrame, keys=KEYS, width: int = BIN) -> DataFrame:
    """Bases that two sets of disjoint intervals share, by group."""
    return overlap_join(left, right, keys, width=width).groupBy(*keys).agg(F.sum(F.least("stop", "r_stop") - F.greatest("start", "r_start")).cast("long").alias("bases"))


def nearest(queries: DataFrame, targets: DataFrame, keys=KEYS, width: int | None = BLOCK) -> DataFrame:
    """queries with upstream_stop (largest target stop below start) and downstream_start (smallest target start above stop).

    Two sweeps in blocks over the union of both sides, so targets are read once for each and nothing is joined to them."""
    cols, row = queries.columns, F.struct(*queries.columns)
    none = F.lit(None).cast(queries.select(row.alias("r")).schema["r"].dataType)
    side = lambda q, t, at, last: q.select(*keys, at.alias("_at"), F.lit(last).alias("_last"), F.lit(None).cast("long").alias("_t"), row.alias("_row")).unionByName(t)
    # of rows at one place, queries come before targets where those ahead or behind must lie strictly beyond them
    up = side(queries, targets.select(*keys, F.col("stop").alias("_at"), F.lit(1).alias("_last"), F.col("stop").alias("_t"), none.alias("_row")), F.col("start"), 0)
    up = running(up, keys, [F.col("_at"), F.col("_last")], "_at", {"upstream_stop": Take("max", F.col("_t"))}, width).where("_row is not null")
    row_up = F.struct(F.col("_row"), "upstream_stop")
    found = up.select(*keys, F.col("_row.stop").alias("_at"), F.lit(1).alias("_last"), F.lit(None).cast("long").alias("_t"), row_up.alias("_row"))
    blank = F.lit(None).cast(found.schema["_row"].dataType)
    down = found.unionByName(targets.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_last"), F.col("start").alias("_t"), blank.alias("_row")))
    down = running(down, keys, [F.col("_at"), F.col("_last")], "_at", {"downstream_start": Take("min", F.col("_t"), ahead=True)}, width).where("_row is not null")
    return down.select(*(F.col(f"_row._row.{c}").alias(c) for c in cols), F.col("_row.upstream_stop").alias("upstream_stop"), "downstream_start")


def band_join(left: DataFrame, right: DataFrame, tolerance: int, keys=KEYS) -> DataFrame:
    """Pairs whose starts and stops both differ by at most `tolerance`; right columns get the prefix r_."""
    other = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns))
    if tolerance == 0:
        return left.join(other, [*keys]).where((F.col("start") == F.col("r_start")) & (F.col("stop") == F.col("r_stop")))
    width = tolerance + 1
    cell = F.floor(F.col("start") / F.lit(width)).cast("long")
    near = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    return near.join(other.withColumn("_cell", F.floor(F.col("r_start") / F.lit(width)).cast("long")), [*keys, "_cell"]).where((F.abs(F.col("start") - F.col("r_start")) <= tolerance) & (F.abs(F.col("stop") - F.col("r_stop")) <= tolerance)).drop("_cell")


def band_counts(pred: DataFrame, true: DataFrame, tolerance: int, keys=KEYS) -> DataFrame:
    """One row: tp (predictions with a match), fp, fn (true intervals without one), over distinct intervals."""
    cols = [*keys, "start", "stop"]
    p, t = pred.select(*cols).distinct(), true.select(*cols).distinct()
    pairs = band_join(p, t, tolerance, keys)
    hit_p = pairs.select(*cols).distinct().agg(F.count(F.lit(1)).alias("tp"))
    hit_t = pairs.select(*keys, "r_start", "r_stop").distinct().agg(F.count(F.lit(1)).alias("hit"))
    sums = hit_p.withColumn("k", F.lit(1)).join(hit_t.withColumn("k", F.lit(1)), "k").join(p.agg(F.count(F.lit(1)).alias("n_pred")).withColumn("k", F.lit(1)), "k").join(t.agg(F.count(F.lit(1)).alias("n_true")).withColumn("k", F.lit(1)), "k")
    return sums.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("hit")).alias("fn"))


def outer_match(pred: DataFrame, true: DataFrame, keys=KEYS) -> DataFrame:
    """Full outer match on equal coordinates with flags predicted and labeled."""
    cols = [*keys, "start", "stop"]
    p, t = pred.select(*cols).distinct().withColumn("predicted", F.lit(True)), true.select(*cols).distinct().withColumn("labeled", F.lit(True))
    return p.join(t, cols, "full").select(*cols, F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("labeled", F.lit(False)).alias("labeled"))


def span(df: DataFrame, *keys: str) -> DataFrame:
    """Smallest start and largest stop by group."""
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def pad(start: Column, stop: Column, margin: int, length: Column) -> tuple[Column, Column, Column, Column]:
    """A slice widened by margin on both sides and clipped to [0, length), and where the slice lies in it."""
    a, b = F.greatest(start - margin, F.lit(0)), F.least(stop + margin, length)
    return a, b, start - a, stop - a


def clusters(pred: DataFrame, true: DataFrame, keys=KEYS, width: int | None = BLOCK) -> DataFrame:
    """Connected components of overlaps between predicted and true intervals (columns id, start, stop and keys each).

    Returns (side, id, cluster) where side is "pred" or "true" and cluster is the smallest member, as side and id joined by
    a colon. Intervals without a partner are clusters of their own.

    A sweep by start, in blocks: at a join, an interval that starts while one of the other side is open, all open intervals are of one
    component. Two joins in a row are of one if an interval that was open at the first still is at the second, and an interval that
    is no join itself belongs to the next join if it is open there."""
    cols = [*keys, "start", "stop", F.col("id").cast("string").alias("id")]
    x = pred.select(F.lit("pred").alias("side"), *cols).unionByName(true.select(F.lit("true").alias("side"), *cols))
    order, start = [F.col(c) for c in ("start", "stop", "side", "id")], F.col("start")
    side = lambda k: Take("max", F.when(F.col("side") == k, F.col("stop")))
    x = running(x, keys, order, "start", {"_p": side("pred"), "_t": side("true"), "_reach": Take("max", F.col("stop"), here=True)}, width)
    x = x.withColumn("_join", F.coalesce(F.when(F.col("side") == "pred", F.col("_t")).otherwise(F.col("_p")) > start, F.lit(False)))
    x = running(x, keys, order, "start", {"_held": Take("near", F.when(F.col("_join"), F.col("_reach")))}, width)
    x = x.withColumn("_new", (F.col("_join") & F.coalesce(F.col("_held") <= start, F.lit(True))).cast("int"))
    x = running(x, keys, order, "start", {"_part": Take("sum", F.col("_new"), here=True)}, width)
    x = running(x, keys, order, "start", {"_next": Take("near", F.when(F.col("_join"), F.struct("start", "_part")), ahead=True)}, width)
    part = F.when(F.col("_join"), F.col("_part")).when(F.col("_next.start") < F.col("stop"), F.col("_next._part"))
    x = x.select(*keys, "side", "id", part.alias("_part"), F.concat_ws(":", "side", "id").alias("node"))
    least = x.where("_part is not null").groupBy(*keys, "_part").agg(F.min("node").alias("cluster"))
    return x.join(least, [*keys, "_part"], "left").select("side", "id", F.coalesce("cluster", "node").alias("cluster"))


def out_of_order(df: DataFrame, keys=("seq",), order: str = "row", width: int | None = BLOCK) -> DataFrame:
    """(keys, n_bad): rows that start before the one ahead of them in `order` (a number), by group; 0 for sorted groups."""
    x = running(df, keys, [F.col(order)], order, {"_ahead": Take("near", F.col("start"))}, width)
    return x.groupBy(*keys).agg(F.sum(F.coalesce((F.col("_ahead") > F.col("start")).cast("long"), F.lit(0))).alias("n_bad"))


def masked_share_at_most(windows: DataFrame, masks: DataFrame, share: float, keys=KEYS) -> DataFrame:
    """The windows (keys, start, stop) of which masks cover at most that share; overlapping masks count once."""
    hit = overlap_join(windows.select(*keys, "start", "stop").distinct(), merge(masks, keys).select(*keys, "start", "stop"), keys)
    covered = hit.groupBy(*keys, "start", "stop").agg(F.sum(F.least("stop", "r_stop") - F.greatest("start", "r_start")).alias("_masked"))
    x = windows.join(covered, [*keys, "start", "stop"], "left")
    return x.where(F.coalesce("_masked", F.lit(0)) <= (F.col("stop") - F.col("start")) * share).select(*windows.columns)
