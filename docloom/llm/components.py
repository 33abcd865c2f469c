"""Connected components by alternating large and small stars, over written tables.

Edges move towards the smallest node they can reach until every node points at its component's smallest one. Each step is a
minimum for each node, combined on the map side, and a join of two written tables, which AQE splits where a node is a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import discard, materialise


def _is_star_forest(e: DataFrame) -> bool:
    """Every node that is not a root points at one root, and roots point at nothing."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
    odd = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).filter("out > 1 OR (out = 1 AND in_ = 1)")
    return not odd.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, root for every node that is not its own root."""
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        moved = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        nxt = materialise(moved.distinct(), "edges")
        for t in (e, low, large, low2):
            discard(t)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
