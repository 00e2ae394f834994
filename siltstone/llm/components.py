"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), comparable non-null ids in any order, repeats and loops allowed -> (node, root) of each node with an edge.

    root is the component's smallest id, and is its own root. A round hooks every node to the smallest of its
    neighbours, which needs O(log² n) rounds; minima are taken before the shuffle, and the joins that follow only
    match one row to many, so adaptive execution can split a hub. Each round is cut in the checkpoint folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
