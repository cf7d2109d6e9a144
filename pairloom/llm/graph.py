"""Connected components of an edge list that never leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node reachable. Nodes without edges are absent.

    Alternating large-star and small-star rounds: every round hangs each node on the smallest
    neighbour it knows, so the number of rounds grows with the logarithm of the longest path. Minima
    are taken with map-side aggregation and joined back, so a hub is no group in one task.
    """
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest one (or to the node itself)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct())
        # small star: smaller neighbours and the node itself go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
        small = small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        new = staged(small)
        moved = new.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if moved == 0:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
