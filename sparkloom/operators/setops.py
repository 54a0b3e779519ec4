"""Set operations, with and without duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def except_then_union(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """``(a EXCEPT b) UNION c``."""
    return a.subtract(b).unionByName(c).distinct()


def subtract_all(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of ``a`` whose value is absent from ``b``; duplicates stay."""
    return a.join(b.select(column).distinct(), column, "left_anti")


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def distinct_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Unique rows of the key columns."""
    return df.select(*keys).distinct() if keys else df.distinct()


def overlap_sizes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sizes of two key sets and of their intersection, from one grouped union."""
    tagged = a.select(column, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        b.select(column, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = tagged.groupBy(column).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.agg(
        F.sum("_a").alias("n_first"), F.sum("_b").alias("n_second"),
        F.sum(F.col("_a") * F.col("_b")).alias("n_common"),
    )
