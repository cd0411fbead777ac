"""Samples of bounded size that depend on the rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a hash's place in its range for each doubling.
_STEPS = 8


def step_of(h: Column) -> Column:
    """The step that a 64-bit hash lies on: steps grow with the hash, by a factor of 2 ** (1 / 8)."""
    return F.floor(F.log2(h.cast("double") + F.lit(2.0**63 + 1)) * _STEPS).cast("int")


def cut_step(hashes: DataFrame, h: Column, n: int) -> int:
    """The least step at or under which n rows lie, or the last one: the driver sees one row for each of some 500 steps."""
    rows = 0
    step = -1
    for step, count in sorted(hashes.groupBy(step_of(h).alias("step")).count().collect()):
        rows += count
        if rows >= n:
            break
    return step


def least_by_hash(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows with the least hash of the columns ``by`` (all, if there are fewer); ties by the columns themselves.

    Hashes are counted by step first and rows above the step of the n-th are left out before sorting, so that a task
    hands on about its share of n rows and not n.
    """
    h = F.xxhash64(*by)
    return df.where(step_of(h) <= cut_step(df, h, n)).orderBy(h, *by).limit(n)
