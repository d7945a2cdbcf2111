"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum by key and a join, so no component is ever gathered in a task or
on the driver. Nodes with very many links, fewer than ``common.HEAVY_KEYS`` of them, meet
their minimum by broadcast. The number of steps grows with the logarithm of the longest
path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, heavy_limit


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): m is the smaller of u and its least neighbour."""
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    heavy = least.filter(F.col("n") > heavy_limit(rows)).drop("n")
    out = edges.join(least.drop("n"), "u") if heavy.isEmpty() else edges.join(F.broadcast(heavy), "u").unionByName(edges.join(F.broadcast(heavy), "u", "left_anti").join(least.drop("n"), "u"))
    return out.withColumn("m", F.least("u", "m"))


def components(links: DataFrame, most_steps: int = 100) -> DataFrame:
    """(u, v) links to (node, root) for every node of a link; root is the least node of its component."""
    edges = links.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct()
    edges = checkpointed(edges)
    n, seen = edges.count(), None
    for _ in range(most_steps):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = _with_least(both, 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = checkpointed(stars.filter(F.col("u") > F.col("v")))
        small = _with_least(smaller, n)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = checkpointed(moved.filter(F.col("u") > F.col("v")).distinct())
        n, mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == seen:
            break
        seen = (n, mark)
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
