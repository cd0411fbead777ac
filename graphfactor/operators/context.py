"""Entity lists that grow: rows get the index of an equal entry, or are entered as new ones.

The lists of a context live in the shared folder; each call reads the list of its key, and writes what it adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_table
from .dense import dense_index


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


class EntityContext:
    """Lists by key, and the indices of tracked objects. Columns named idx, is_new and names that begin with _ are its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._lists: dict[str, DataFrame] = {}
        self._tracked: DataFrame | None = None

    def collection(self, key: str, schema: T.StructType | None = None) -> DataFrame:
        """idx and the columns of a list, null where a gap was filled; empty for a key without entries."""
        if key not in self._lists:
            return self.spark.createDataFrame([], T.StructType([T.StructField("idx", T.LongType()), *(schema or T.StructType())]))
        return self._lists[key]

    def _checked(self, key: str, schema: T.StructType) -> None:
        if key in self._lists:
            known = [(f.name, f.dataType) for f in self._lists[key].schema if f.name != "idx"]
            if known != [(f.name, f.dataType) for f in schema]:
                raise TypeError(f"rows of {key} have the columns {known}")

    def get_or_add_index(self, key: str, rows: DataFrame, order: str) -> DataFrame:
        """rows with idx and is_new. Equal rows (in all columns but ``order``; null equals null) share an entry; entries
        are numbered in order of the least ``order`` of their rows, after those there are. is_new is true for that
        row only. ``order`` must be unique."""
        names = [c for c in rows.columns if c != order]
        self._checked(key, rows.select(*names).schema)
        marked = [f"_{c}" for c in names]
        old = self.collection(key, rows.select(*names).schema)
        size = old.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
        firsts = rows.groupBy(*names).agg(F.min(order).alias("_first"))
        known = old.select("idx", *(F.col(c).alias(m) for c, m in zip(names, marked, strict=True)))
        fresh = firsts.join(known, _same(names, marked), "left_anti")
        added = dense_index(fresh, "_first").select((F.col("idx") + size).cast("long").alias("idx"), *names, "_first")
        added = shared_table(added, "added")
        self._lists[key] = old.select("idx", *names).unionByName(added.drop("_first"))
        every = known.withColumn("_first", F.lit(None).cast(rows.schema[order].dataType)).unionByName(added.select("idx", *(F.col(c).alias(m) for c, m in zip(names, marked, strict=True)), "_first"))
        joined = rows.join(every, _same(names, marked))
        return joined.select(*rows.columns, "idx", F.coalesce(F.col("_first") == F.col(order), F.lit(False)).alias("is_new"))

    def add_to_collection(self, key: str, rows: DataFrame) -> None:
        """Put rows (idx and columns) at their places: over what is there, or after it, gaps filled with nulls."""
        names = [c for c in rows.columns if c != "idx"]
        rows = rows.select(F.col("idx").cast("long").alias("idx"), *names)
        self._checked(key, rows.select(*names).schema)
        low, high = rows.agg(F.min("idx"), F.max("idx")).first()
        if low is not None and low < 0:
            raise IndexError(f"no place {low} in a list")
        old = self.collection(key, rows.select(*names).schema)
        top = max(-1 if high is None else high, old.agg(F.coalesce(F.max("idx"), F.lit(-1))).first()[0])
        kept = old.join(rows.select("idx"), "idx", "left_anti").unionByName(rows)
        places = self.spark.range(top + 1).select(F.col("id").alias("idx"))
        self._lists[key] = shared_table(places.join(kept, "idx", "left"), "list")

    def track(self, sources: DataFrame) -> None:
        """sources: source (long) and idx. Objects tracked before keep their index."""
        new = sources.select(F.col("source").cast("long").alias("source"), F.col("idx").cast("long").alias("idx")).dropDuplicates(["source"])
        self._tracked = shared_table(new if self._tracked is None else self._tracked.unionByName(new.join(self._tracked, "source", "left_anti")), "tracked")

    def tracked(self, sources: DataFrame) -> DataFrame:
        """source and idx, null for objects that aren't tracked."""
        if self._tracked is None:
            return sources.select("source", F.lit(None).cast("long").alias("idx"))
        return sources.select("source").join(self._tracked, "source", "left")
