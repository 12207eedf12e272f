"""Connected components of a table of links, by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node of links(a, b), label being the smallest node reachable.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed to their roots by
    doubling, and the links between different roots are the next round's table. A node that is not smaller than all its
    neighbours is no root, so tables at least halve, and a hub with all its neighbours is gone after one round."""
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    alone = links.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = materialize(edges, "edges", True)
    levels: list[DataFrame] = []
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = materialize(both.groupBy("node").agg(F.min("other").alias("up")).select("node", F.least("node", "up").alias("up")), "up", True)
        for _ in range(rounds):
            jump = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            new = materialize(jump, "up", True)
            release(up)
            up = new.select("node", "up")
            if not new.where("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"pointers not at their roots after {rounds} rounds")
        levels.append(up)
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("p")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("q")), "b").where("p <> q")
        new = materialize(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges", True)
        release(edges)
        edges = new
        if not edges.limit(1).count():
            break
    else:
        raise RuntimeError(f"links left after {rounds} rounds")
    label = levels[-1].select("node", F.col("up").alias("label"))
    for level in reversed(levels[:-1]):
        label = level.join(label.select(F.col("node").alias("up"), "label"), "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    label = label.unionByName(alone.join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
    out = materialize(label, "labels", True)
    release(edges, *levels)
    return out
