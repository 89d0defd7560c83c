"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.staging import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is one node of its component.

    In a round every node joins the neighbour that comes first in a random order (a hash), if
    that comes before itself, and edges are rewritten to the joined nodes. Only nodes before all
    their neighbours stay, so the edges shrink by a constant factor at least and a path needs a
    logarithmic number of rounds. Minima are folded map-side; a hub's edges meet one row for it.
    Every round is written down, so a lost executor repeats one round at most.
    """
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    live = stage(live.where(F.col("a") != F.col("b")).distinct(), "edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    roots = stage(nodes.withColumn("root", F.col("node")), "roots")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b").alias("order"), F.col("b").alias("to")))
        best = both.groupBy("a").agg(first.alias("best"))
        own = F.struct(F.xxhash64("a").alias("order"), F.col("a").alias("to"))
        joined = stage(best.select("a", F.least("best", own)["to"].alias("to")), "joined")
        rewritten = (
            live.join(joined, "a")
            .select(F.col("to").alias("from"), F.col("b").alias("a"))
            .join(joined, "a")
            .select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b"))
        )
        step = joined.select(F.col("a").alias("root"), "to")
        moved = roots.join(step, "root", "left")
        roots = stage(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        live = stage(rewritten.where(F.col("a") != F.col("b")).distinct(), "edges")
    return roots
