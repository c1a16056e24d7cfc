"""Connected components of a graph, by joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, spread_join, stored


def _order(node: Column, turn: int) -> Column:
    """What neighbours are compared by: their numbers in the first two turns, then hashes of them."""
    return F.xxhash64(node, F.lit(turn)) if turn > 1 else node


def connected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label): each node of edges (u, v), two longs, with the smallest node that it can reach.

    Each turn every node is called by the first of itself and its neighbours, and edges between nodes of different names
    become edges between the names, until none are left. By number a star of any size takes two turns at most; by hash
    long paths, too, lose a constant share of their nodes. Minima are taken before rows are exchanged, and nodes or names
    with a large share of all rows are dealt out, so hubs land in no single task. Every turn is cut off by a table in
    the shared folder (a checkpoint would carry the constraints of all turns along, and plans would grow), in as many
    files as its rows need. rows: an upper bound of the edges, where one is known. Nodes without edges don't appear;
    loops and repeated edges are allowed, nulls aren't.
    """
    spark = edges.sparkSession
    left, place = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), rows)
    levels: list[DataFrame] = []
    nodes = None
    # (A node's times are counted in both directions, so twice the edges are all of them, and more than there are nodes.)
    while total := 2 * left.count():
        turn, nodes = len(levels), nodes or total
        both = left.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(left.select(F.col("v").alias("node"), F.col("u").alias("other")))
        by = _order(F.col("other"), turn)
        named = both.groupBy("node").agg(F.min_by("other", by).alias("other"), F.min(by).alias("by"), F.count("*").alias("times"))
        own = _order(F.col("node"), turn)
        level, _ = stored(named.select("node", F.when(own <= F.col("by"), F.col("node")).otherwise(F.col("other")).alias("label"), "times"), total)
        levels.append(level)
        ends = left
        for end, other in (("u", "v"), ("v", "u")):
            names = level.select(F.col("node").alias(end), F.col("label").alias(f"new_{end}"), "times")
            ends = spread_join(ends, names, [end], "times", F.hash(other), total)
        a, b = F.col("new_u"), F.col("new_v")
        before = place
        left, place = stored(ends.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), total // 2)
        removed(spark, before)
    if not levels:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    # Names of names, from the last turn back; then the smallest node of each.
    roots = levels[-1].select("node", "label")
    for level in levels[-2::-1]:
        uses = level.groupBy("label").agg(F.count("*").alias("times"))
        names = uses.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").withColumn("root", F.coalesce("root", "label"))
        roots, _ = stored(spread_join(level.select("node", "label"), stored(names, nodes)[0], ["label"], "times", F.hash("node")).select("node", F.col("root").alias("label")), nodes)
    least, _ = stored(roots.groupBy("label").agg(F.min("node").alias("least"), F.count("*").alias("times")), nodes)
    return spread_join(roots, least, ["label"], "times", F.hash("node")).select("node", F.col("least").alias("label"))
