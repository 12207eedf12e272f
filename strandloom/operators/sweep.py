"""Running aggregates along an order, in two levels, so that no task sorts a whole sequence.

Rows are dealt over blocks of `width` along a number. Each block's aggregates make one row; a window over these rows gives what
each block takes over from those before (or after) it, and a window inside the block does the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the blocks, in bases or rows.
BLOCK = 1 << 17


@dataclass
class Take:
    """One running aggregate of `value`: max, min, sum, count-like sums, or the nearest value that is not null ("near").

    ahead: over the rows from here to the end instead of those from the beginning to here; here: with the row itself."""

    kind: str
    value: Column
    ahead: bool = False
    here: bool = False


OWN = {"max": F.max, "min": F.min, "sum": F.sum}


def _framed(take: Take, value: Column, w) -> Column:
    w = w.rowsBetween(Window.unboundedPreceding, 0 if take.here else -1)
    return (F.last(value, True) if take.kind == "near" else OWN[take.kind](value)).over(w)


def _ways(x: DataFrame, by: list, order: list, takes: list[Take], number: str) -> tuple:
    """(x, window forth, window back). Frames that end with their group are made anew for each row, so what lies ahead is taken in the reverse
    order, for which rows get numbers, as the order may leave some equal."""
    forth = Window.partitionBy(*by).orderBy(*order)
    if any(t.ahead for t in takes):
        x = x.withColumn(number, F.row_number().over(forth))
    return x, forth, Window.partitionBy(*by).orderBy(F.desc(number))


@dataclass
class Step:
    """Columns that are added to the rows, one after the other, and running aggregates over them in an order."""

    order: list[Column]
    takes: dict[str, Take]
    made: dict[str, Column] = field(default_factory=dict)


def running(df: DataFrame, keys, order: list[Column], place: str | Column, takes: dict[str, Take], width: int | None = BLOCK, dealt: bool = False) -> DataFrame:
    """df with the columns that takes names, in each group of keys. place is a number that grows with the order; rows of one place
    stay in one block. Nulls in keys are values like others. Sums are null where there is no row. width None: groups are small, such
    as one transcript's parts, and a plain window over each of them does. dealt: see steps()."""
    return steps(df, keys, place, [Step(order, takes)], width, dealt)


def steps(df: DataFrame, keys, place: str | Column, each: list[Step], width: int | None = BLOCK, dealt: bool = False) -> DataFrame:
    """running() several times, each step over the columns of those before. All orders grow with place, so the rows are dealt over blocks once.

    Blocks are summed up before the rows are dealt, which moves little where a task meets many rows of a block. dealt: afterwards, from
    the shuffle that the rows come from; that moves nothing twice if the first step's aggregates need all columns of df but the keys."""
    cols, keys = df.columns, list(keys)
    own = "_k"  # the sweep's own columns begin with it, and no column that is given or asked for does
    while any(c.lower().startswith(own) for c in (*cols, *(c for s in each for c in (*s.made, *s.takes)))):
        own += "_"
    if width is None:
        for s in each:
            x, forth, back = _ways(df.withColumns(s.made), keys, s.order, list(s.takes.values()), f"{own}n")
            df = x.select("*", *(_framed(t, t.value, back if t.ahead else forth).alias(name) for name, t in s.takes.items())).drop(f"{own}n")
        return df
    place = F.col(place) if isinstance(place, str) else place
    # the keys travel in own alone, and orders and values are made where they are used, so that the rows of the shuffle are narrow
    x = df.withColumn(own, F.struct(*keys, F.floor(place / F.lit(width)).alias("_block")))
    if dealt:
        x = x.drop(*keys).repartition(own).select(*(F.col(f"{own}.{c}").alias(c) if c in keys else c for c in cols), own)
    by_block = Window.partitionBy(*(f"{own}.{k}" for k in keys)) if keys else Window.partitionBy(F.lit(0))
    for n, s in enumerate(each):
        x, cols = x.withColumns(s.made), [*cols, *s.made]
        order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(s.order)))
        parts, carried = [], []
        for k, t in enumerate(s.takes.values()):
            v = t.value
            kept = F.when(v.isNotNull(), F.struct(order.alias("_o"), v.alias("v")))
            parts.append((OWN[t.kind](v) if t.kind in OWN else (F.min(kept) if t.ahead else F.max(kept))["v"]).alias(f"_p{k}"))
            w = by_block.orderBy(F.desc(f"{own}._block") if t.ahead else F.col(f"{own}._block")).rowsBetween(Window.unboundedPreceding, -1)
            p = F.col(f"_p{k}")
            carried.append((OWN[t.kind](p) if t.kind in OWN else F.last(p, True)).over(w).alias(f"{own}c{k}"))
        carry = x.groupBy(own).agg(*parts).select(own, *carried)
        kept = [F.col(f"{own}.{c}").alias(c) if c in keys and not n else F.col(c) for c in cols]
        x = (x if n else x.drop(*keys)).join(carry, own).select(*kept, own, *(f"{own}c{k}" for k in range(len(s.takes))))
        x, forth, back = _ways(x, [own], [order], list(s.takes.values()), f"{own}n")
        out = []
        for k, (name, t) in enumerate(s.takes.items()):
            near, c = _framed(t, t.value, back if t.ahead else forth), F.col(f"{own}c{k}")
            both = {"max": F.greatest(near, c), "min": F.least(near, c), "sum": F.when(near.isNull() & c.isNull(), None).otherwise(F.coalesce(near, F.lit(0)) + F.coalesce(c, F.lit(0))), "near": F.coalesce(near, c)}
            out.append(both[t.kind].alias(name))
        x, cols = x.select(*cols, own, *out), [*cols, *s.takes]
    return x.drop(own)
