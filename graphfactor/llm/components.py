"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of links (a, b): component is the least id that it reaches.

    Alternates large-star and small-star steps, which keep each component together and end with a star around its
    least id; a step shuffles the links once by the larger or smaller end. Each round is written to the shared folder.
    Null ends and loops are dropped; repeated links count once.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges", 1)
    state = None
    while True:
        # large-star: every neighbour above u goes to the least id around u, u included
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every neighbour below u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, scratch.table(small, "edges", 1)
        scratch.drop(last)
        now = edges.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = scratch.table(ends.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), "components", 1)
    scratch.drop(edges)
    return out
