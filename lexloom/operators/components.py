"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is named by its smallest node.

    Each round points neighbours at the smallest node they know, which ends in stars after O(log^2 n) rounds. Neighbour lists are never
    collected: a star step is a grouped minimum and a join on the node. Every round is written to the shared folder, so lineage stays
    short. Self-loops make single nodes, null ends are ignored, repeated edges count once, no edges give no rows."""
    clean = edges.select("a", "b").dropna()
    loops = clean.where("a = b").select(F.col("a").alias("node"))
    e = materialize(clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).unionByName(loops).distinct()
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node is linked with the smallest node around it.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked with the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        new = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        same = e.exceptAll(new).limit(1).count() == 0 and new.exceptAll(e).limit(1).count() == 0
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
