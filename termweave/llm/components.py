"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

#: Edges up to which the minima of nodes are broadcast: a few MB.
FEW_EDGES = 200_000


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges (a long, b long) to (node long, root long): the smallest node reachable, one row per node with an edge.

    Each round is two joins against a minimum per node; the neighbour lists of a node are never gathered, and a hub, the
    key of many edges, is joined apart and without a shuffle. Rounds are logarithmic in a component's size. Self loops and
    repeated edges do not matter. Each round is written to the shared folder, which cuts the lineage.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark = _closed(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        few = mark[0] <= FEW_EDGES
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_low(both.filter("v > u"), both, few, 2 * mark[0]).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if few else written(large, "large-star")
        linked = _with_low(large, large, few, mark[0])
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).distinct()
        e, now = _closed(small)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_low(rows: DataFrame, of: DataFrame, few: bool, total: int) -> DataFrame:
    """rows (u, v) with m, the least v that their u has in `of`; few: whether `of` is known to be small."""
    low = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    if few:
        return rows.join(F.broadcast(low.drop("k")), "u")
    return join_groups(rows, written(low, "lows"), "u", "k", total, "inner").drop("k")


def _closed(e: DataFrame) -> tuple[DataFrame, tuple]:
    """e, written, with a mark that is equal for equal edge sets."""
    e = written(e, "edges")
    row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return e, tuple(row)
