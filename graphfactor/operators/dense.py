"""Dense numbers over a whole table, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_table


def dense_index(df: DataFrame, by: str) -> DataFrame:
    """df with idx from 0 in order of ``by`` (which must be unique): rows are dealt into ranges, numbered within each,
    and moved up by what the ranges before hold, one count per range. The ranges are kept as a table meanwhile, so
    that a lost executor can't deal them out differently."""
    dealt = shared_table(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range: a single task adds them up
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return dealt.withColumn("idx", own).join(before, "_range").withColumn("idx", (F.col("idx") + F.col("_before")).cast("int")).drop("_range", "_before")
