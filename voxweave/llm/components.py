"""Connected components of a distributed edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.llm.tables import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> one row (node, root) per node that has an edge; root is the smallest node it reaches.

    Alternating large-star and small-star steps: each node's larger, then its smaller, neighbours are hung
    on the smallest node of the neighbourhood, until all edges lead to a root. The rows stay as many as there
    are edges, every step is written to the shared folder, and a hub's edges are summed before they meet.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small)
        # settled when every node hangs on a root: no edge's upper end is another edge's lower end
        if after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and after.groupBy("u").count().filter("count > 1").isEmpty():
            break
        discard(now)
        now = after
    discard(now)
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
