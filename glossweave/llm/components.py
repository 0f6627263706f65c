"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large-star links every larger neighbour to the node's minimum; small-star every smaller one and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that can be reached.

    Both steps need minima and one equi-join only, so a node with a third of all links is combined before the shuffle and its join
    partition is split by AQE. Every round is written to the shared folder. Null ends, loops and repeated edges link nothing.
    """
    named = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialise(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        after = materialise(_star(now, True).transform(lambda d: _star(d, False)), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = materialise(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    drop(now)
    return found
