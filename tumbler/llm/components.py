"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tumbler.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for every node in links (a, b: long). Order and repeats don't matter.

    Null links are not allowed. The result is a written table. Each step is a sum-like aggregation (a minimum for each node) and a join back; steps are written to the shared
    folder. Their number grows with the logarithm of the longest path.
    """
    edges, mark = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"), None
    nodes = cut(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        new = cut(small.distinct(), "links")
        drop(edges)
        edges = new
    found = nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left")
    out = cut(found.select("node", F.coalesce("root", "node").alias("root")), "roots")
    drop(nodes, edges)
    return out
