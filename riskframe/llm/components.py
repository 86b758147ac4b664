"""Connected components of a graph given as edges, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import pin


def _rank(c: str) -> Column:
    # nodes are compared by a hash of their number, so that a path in numeric
    # order still contracts by a constant factor in each round
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u bigint, v bigint); nodes of one component share a root.

    Each round every node moves to the lowest-ranked of itself and its
    neighbours, the edges are drawn anew between what is left, and loops and
    repeated edges go. The edge table shrinks geometrically and is written each
    round; nothing but its emptiness reaches the driver.
    """
    live = pin(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = pin(both.groupBy("u").agg(F.min(_rank("v")).alias("near"))
                   .select("u", F.least(_rank("u"), F.col("near"))["x"].alias("to")), "parents")
        if roots is None:
            roots = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            moved = step.select(F.col("u").alias("root"), "to")
            roots = (roots.join(moved, "root", "left")
                     .select("node", F.coalesce("to", "root").alias("root")))
        roots = pin(roots, "roots")
        a = live.join(step, "u").select(F.col("to").alias("u"), "v")
        b = a.join(step.select(F.col("u").alias("v"), "to"), "v").select("u", F.col("to").alias("v"))
        live = pin(b.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if roots is None:
        roots = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
