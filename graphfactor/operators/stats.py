"""How much factoring saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..container import Container
from ..plans.catalog import PropKind


def dedup_stats(container: Container) -> DataFrame:
    """list, occurrences, entries, over all roots: how often entries of a list are referred to, and how many there are.

    References are counted after factoring, in entries that are themselves distinct; a root counts as one reference.
    """
    graph = container.graph
    entries = container.counts().withColumnRenamed("n", "entries")
    refs = None
    for node in graph.nodes:
        frame = container[graph.lists[node.name]]
        sums = [
            F.struct(F.lit(graph.lists[p.target]).alias("list"), F.sum(F.size(p.column).cast("long") if p.kind is PropKind.COLLECTION else F.col(p.column).isNotNull().cast("long")).alias("n"))
            for p in node.links
        ]
        if node.name == graph.root:
            sums.append(F.struct(F.lit(graph.lists[node.name]).alias("list"), F.count("*").alias("n")))
        if sums:
            one = frame.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.list", "x.n")
            refs = one if refs is None else refs.union(one)
    total = refs.groupBy("list").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    return total.join(entries, "list").select("list", "occurrences", "entries")
