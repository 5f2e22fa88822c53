"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import discard, materialize


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest
    node reachable.

    A round is two aggregations and joins on the node. The minimum of a
    node's neighbours is combined before the shuffle and joined back, so a hub
    with any number of edges is never one task's group (adaptive skew joins
    split its edges). The number of rounds is logarithmic in the longest path.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), name)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = materialize(large, f"{name}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
                 .select(F.explode(F.array("x", "a")).alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        nxt = materialize(small, f"{name}-small")
        same = now.count() == nxt.count() and not nxt.join(now, ["a", "b"], "left_anti").limit(1).count()
        discard(large)
        discard(now)
        now = nxt
        if same:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
