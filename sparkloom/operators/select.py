"""Filters, samples, selectors and cleaning rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut_lineage


def count_where(df: DataFrame, column: str, value, out: str = "n") -> DataFrame:
    """Parameterised equality count; the value is bound, never pasted in."""
    return df.sparkSession.sql(
        f"SELECT count(*) AS {out} FROM {{rows}} WHERE {column} = :value", args={"value": value}, rows=df
    )


def groups_over(df: DataFrame, predicate: Column | str, key: str, n: int) -> DataFrame:
    """Keys of the rows passing ``predicate`` that occur more than ``n`` times."""
    return df.filter(predicate).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > n)


def count_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).like(pattern)).agg(F.count(F.lit(1)).alias("n"))


def within_box(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with lat/lon inside ``(lat_min, lat_max, lon_min, lon_max)``, borders included."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    return df.filter(F.col(lat).between(lo_lat, hi_lat) & F.col(lon).between(lo_lon, hi_lon))


def within_box_of(df: DataFrame, lat: str, lon: str, other: DataFrame, olat: str, olon: str) -> DataFrame:
    """As :func:`within_box`, the box being the extent of another table."""
    box = other.agg(F.min(olat).alias("a"), F.max(olat).alias("b"), F.min(olon).alias("c"), F.max(olon).alias("d"))

    def bound(name):
        return box.select(name).scalar()

    return df.filter(F.col(lat).between(bound("a"), bound("b")) & F.col(lon).between(bound("c"), bound("d")))


def within_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Inclusive date window, written on the raw column so that it is pushed down."""
    c = F.col(column)
    return df.filter((c >= F.lit(start).cast("timestamp_ntz"))
                     & (c < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def in_any_window(value: Column, windows: Iterable[tuple]) -> Column:
    """True if ``value`` lies in one of the inclusive windows."""
    return reduce(or_, [value.between(lo, hi) for lo, hi in windows])


def excluding(df: DataFrame, column: Column, values: list) -> DataFrame:
    """Rows whose value is not listed; NULL values stay."""
    return df.filter(~F.coalesce(column.isin(values), F.lit(False)))


def sample_rows(df: DataFrame, percent: float, seed: int = 7) -> DataFrame:
    """Repeatable Bernoulli sample."""
    return df.sample(withReplacement=False, fraction=percent / 100.0, seed=seed)


def hash_share(key: Column) -> Column:
    """A number in [0, 1) derived from the key alone, equal on every engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sample_by_key(df: DataFrame, key: str, percent: float) -> DataFrame:
    """Sample that keeps the same keys on every run, whatever the partitioning."""
    return df.filter(hash_share(F.col(key)) < percent / 100.0)


def sample_blocks(df: DataFrame, percent: float, name: Column | str = "_metadata.file_path") -> DataFrame:
    """Whole files of a table, drawn by a hash of their ``name``: the same files on every run.

    ``name`` is made from ``_metadata.file_path`` alone, so the draw is settled while files
    are listed and the others are never opened: bytes read are in proportion to
    ``percent``.  ``df`` is a table as read; a block is a file, of whatever size it was written.
    """
    return df.where(hash_share(F.col(name) if isinstance(name, str) else name) < percent / 100.0)


Selector = Callable[[DataFrame], DataFrame]


def select_chain(base: DataFrame, key: str, steps: list[Selector]) -> DataFrame:
    """Apply selectors in turn, each on the set the former ones left.

    The order matters for steps that look at the whole set (cumulative shares).
    A step may return any columns as long as ``key`` is among them.  What a step
    leaves is kept, so that a long chain does not run its first steps again.
    """
    current = base
    for step in steps:
        current = cut_lineage(current.join(step(current).select(key).distinct(), key, "left_semi"))
    return current


def columns_matching(df: DataFrame, prefix: str = "", suffix: str = "", drop: Iterable[str] = ()) -> list[str]:
    gone = set(drop)
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in gone]


def select_by_name(df: DataFrame, prefix: str = "", suffix: str = "", drop: Iterable[str] = (),
                   rename: Callable[[str], str] = lambda c: c) -> DataFrame:
    return df.select(*[F.col(c).alias(rename(c)) for c in columns_matching(df, prefix, suffix, drop)])


def above_average(df: DataFrame, column: str) -> DataFrame:
    """Rows greater than the mean over the whole table."""
    return df.filter(F.col(column) > df.agg(F.avg(column)).scalar())


def null_count(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])


def drop_sparse_rows(df: DataFrame, label: str, max_missing: int) -> DataFrame:
    """Drop rows without a label and rows with more than ``max_missing`` NULLs."""
    return df.filter(F.col(label).isNotNull() & (null_count(df.columns) <= max_missing))


def drop_sparse_columns(df: DataFrame, fraction: float) -> DataFrame:
    """Drop columns whose share of NULLs exceeds ``fraction``; one aggregate row is read."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if (shares[c] or 0.0) <= fraction])


def null_sentinel(column: Column, bad: Column) -> Column:
    """``column`` with NULL where ``bad`` holds."""
    return F.when(~F.coalesce(bad, F.lit(False)), column)


def tag_split(parts: dict[str, DataFrame], name: str = "split") -> DataFrame:
    """Concatenate frames, each labelled with its key."""
    tagged = [df.withColumn(name, F.lit(label)) for label, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)
