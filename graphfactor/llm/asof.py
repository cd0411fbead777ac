"""As-of join in DataFrame operations: for each row the latest earlier row of the other side with its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(left: DataFrame, right: DataFrame, width: int, inclusive: bool) -> DataFrame:
    """left: key, t (long), row; right: key, t (long), row (no nulls in t). Returns key, t, row, found: right's row with
    the greatest t before left's (or at it, if inclusive), of equal t the greatest row; null if there is none.

    Time is cut into buckets of ``width``, and windows run within one key and bucket, so that a key with a large
    share of the rows is spread over its buckets. What a bucket inherits comes from a table of one row per key and
    bucket. Left rows with null key or t find nothing, and aren't shuffled; all left rows stay.
    """
    placed = "key is not null and t is not null"
    bucket = F.floor(F.col("t") / F.lit(width)).cast("long").alias("bucket")
    none = F.lit(None)
    asked = left.where(placed).select("key", "t", bucket, "row", none.cast(right.schema["row"].dataType).alias("hit"), F.lit(1 if inclusive else 0).alias("turn"))
    given = right.where(placed).select("key", "t", bucket, none.cast(left.schema["row"].dataType).alias("row"), F.col("row").alias("hit"), F.lit(0 if inclusive else 1).alias("turn"))
    within = Window.partitionBy("key", "bucket").orderBy("t", "turn", "hit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = asked.union(given).withColumn("near", F.last("hit", ignorenulls=True).over(within)).where("hit is null")

    ends = given.groupBy("key", "bucket").agg(F.max(F.struct("t", "hit")).alias("last"))
    ends = ends.select("key", "bucket", F.lit(1).alias("turn"), F.col("last.hit").alias("far"))
    # each asked bucket inherits from the last given bucket before it
    wanted = asked.select("key", "bucket").distinct()
    marks = wanted.select("key", "bucket", F.lit(0).alias("turn"), none.cast(right.schema["row"].dataType).alias("far")).union(ends)
    over = Window.partitionBy("key").orderBy("bucket", "turn").rowsBetween(Window.unboundedPreceding, -1)
    inherited = marks.withColumn("old", F.last("far", ignorenulls=True).over(over)).where("turn = 0").select(F.col("key").alias("k"), F.col("bucket").alias("b"), "old")
    joined = near.join(inherited, (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")), "left")
    found = joined.select("key", "t", "row", F.coalesce("near", "old").alias("found"))
    return found.union(left.where(f"not ({placed})").select("key", "t", "row", none.cast(right.schema["row"].dataType)))
