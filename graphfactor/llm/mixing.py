"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Words of a text: runs of characters other than space and tab to carriage return.
_WORD = r"[^\x20\x09-\x0D]+"
_NO_ROWS_BEFORE = (Window.unboundedPreceding, -1)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes: source, source_size, one row per source. Adds target.

    Sources in order (nulls last) have the weights in turn and together get ``share`` times all sizes. A target is
    the least of cap * source_size and level * weight; the level is where the targets' sum is right. Taken by rising
    cap / weight, sources before a row are full and the others share what is left: the first row that such a level
    does not fill gives it.
    """
    last = Window.orderBy(F.asc_nulls_last("source"))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(last) - 1) % len(weights) + 1).cast("double"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    every = Window.partitionBy()
    w = w.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(*_NO_ROWS_BEFORE)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order.rowsBetween(*_NO_ROWS_BEFORE)), F.lit(0.0)))
    w = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return w.select("source", "source_size", F.coalesce(F.least("most", level * F.col("weight")), "most").alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text and source. A document's size is its number of words. Returns one row per row of docs:
    doc_id, row (a struct of all columns of docs, so that no name clashes), size, source_size, target (of the
    source), rate (target / source_size), copies: floor(rate), and one more if a number in [0, 1) made from ``seed``
    and doc_id lies under the fraction. The same rows, the same copies, in any order and partitioning.

    Null or empty text: size 0. Null source: a source of its own, last in order. A source without words: target and
    rate 0. Null doc_id: the text stands for it. Repeated rows count with each repeat and get the same copies.
    Empty table: no rows. Targets are worked out in one task over one row per source.
    """
    if any(x <= 0 for x in weights) or share < 0 or cap < share:
        raise ValueError("weights must be positive, and cap at least share")
    sized = docs.select("doc_id", F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))
    # a table of its real size, so that Spark broadcasts it only up to its threshold
    known = scratch.table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).coalesce(1), "targets")
    known = known.withColumnRenamed("source", "named")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.col("row.text"), F.lit("")))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    copies = (F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    joined = sized.join(known, sized.source.eqNullSafe(known.named)).withColumn("rate", rate)
    return joined.select("doc_id", "row", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as ``plan`` says, with docs' columns."""
    taken = plan(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
