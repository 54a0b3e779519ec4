"""Joins.  Broadcasts are left to Catalyst, which checks sizes before choosing one."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import fits_broadcast, global_row_number, materialise, running_totals


def star_join(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner equi-joins of a fact with ``(dimension, left key, right key)`` in turn."""
    return reduce(lambda acc, d: acc.join(d[0], F.col(d[1]) == F.col(d[2])), dimensions, fact)


def count_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, out: str) -> DataFrame:
    """Rows of ``right`` per key of ``left``, 0 where none.

    The right side is counted before the join, so a hot key crosses the network
    as one row per partition.
    """
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias(out))
    return (left.join(counts, F.col(left_key) == F.col("_k"), "left").drop("_k")
            .withColumn(out, F.coalesce(out, F.lit(0).cast("bigint"))))


def cartesian(left: DataFrame, right: DataFrame, strips: int | None = None) -> DataFrame:
    """Every left row with every right row, which is what the operator stands for.

    Both sides are dealt into strips; a strip of one side meets every strip of the other
    through an equality join on the pair of strips.  There are as many strips as let the
    pairs fill the session's shuffle partitions, more of them on a larger cluster.  A
    side that Catalyst knows to be small is sent to all rows of the other instead; sides
    of unknown size are written first, since either way they are read many times.
    """
    if strips is None:
        left, right = (d if fits_broadcast(d) else materialise(d, "side") for d in (left, right))
        if fits_broadcast(left) or fits_broadcast(right):
            one = lambda df: df.withColumn("_one", F.pmod(F.xxhash64(*df.columns), F.lit(1)))  # noqa: E731  a key of one value, joined by broadcast
            return one(left).join(one(right), "_one").select(*left.columns, *right.columns)
        strips = max(2, math.isqrt(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))

    def strip(df):
        return F.pmod(F.xxhash64(*df.columns), F.lit(strips)).cast("int")

    a = left.select("*", strip(left).alias("_l"), every.alias("_r"))
    b = right.select("*", every.alias("_l"), strip(right).alias("_r"))
    return a.join(b, ["_l", "_r"]).select(*left.columns, *right.columns)


def densify(left: DataFrame, right: DataFrame, fact: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """All combinations of two dimensions with the measures of ``fact`` or a fill value."""
    full = cartesian(left, right).join(fact, on, "left")
    return full.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
                         for c in full.columns])


def anti_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def semi_join(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def align_by_key(series: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer alignment of named series: one row per key, a column per series.

    A long union with one pivot replaces a chain of full outer joins.
    """
    parts = [df.select(key, F.col(value).alias("_v"), F.lit(name).alias("_name")) for name, df in series.items()]
    long = reduce(DataFrame.unionByName, parts)
    return long.groupBy(key).pivot("_name", list(series)).agg(F.first("_v", ignorenulls=True))


def lookup_default(df: DataFrame, mapping: DataFrame, key: str, map_key: str, value: str, default) -> DataFrame:
    """Dictionary lookup with a default for unknown keys."""
    m = mapping.select(F.col(map_key).alias("_k"), F.col(value).alias("_v"))
    return (df.join(m, F.col(key) == F.col("_k"), "left")
            .withColumn(value, F.coalesce("_v", F.lit(default))).drop("_k", "_v"))


def lookup_with_fallback(keys: DataFrame, primary: DataFrame, secondary: DataFrame, primary_key: str,
                         secondary_key: str, value: str, default) -> DataFrame:
    """Value by the fine key, else by the coarse key, else the default."""
    p = primary.select(F.col(primary_key), F.col(value).alias("_p"))
    s = secondary.select(F.col(secondary_key), F.col(value).alias("_s"))
    return (keys.join(p, primary_key, "left").join(s, secondary_key, "left")
            .withColumn(value, F.coalesce("_p", "_s", F.lit(default))).drop("_p", "_s"))


def _edges(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key and time how many closed intervals begin (side 0) or end (side 2); equal edges are one row.

    Intervals without a start or an end, or that end before they start, hold no point.
    """
    real = intervals.where(F.col(start) <= F.col(end))
    edge = lambda at, side, step: real.select(*keys, F.col(at).alias("_at"), F.lit(side).alias("_side"), F.lit(step).cast("bigint").alias("_step"))
    return edge(start, 0, 1).unionByName(edge(end, 2, -1)).groupBy(*keys, "_at", "_side").agg(F.sum("_step").alias("_step"))


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching closed intervals per key set, by a sweep.

    Edges are range-partitioned by key and time and the number of open intervals is
    carried from piece to piece; what a key opens it also closes, so the count needs no
    key.  A key with most intervals is many tasks, and a long interval is two rows.
    """
    swept = running_totals(_edges(intervals, keys, start, end), [*keys, "_at", "_side"], {"_step": "_open"})
    # only where nothing was open before, and where nothing is open after
    borders = swept.where(((F.col("_side") == 0) & (F.col("_open") == F.col("_step"))) | (F.col("_open") == 0))
    placed = global_row_number(borders, [*keys, "_at", "_side"], "_n")  # begin, end, begin, end, ...
    merged = placed.groupBy(*keys, F.floor((F.col("_n") + 1) / 2).alias("_block"))
    return merged.agg(F.min("_at").alias(start), F.max("_at").alias(end)).drop("_block")


def flag_active_intervals(points: DataFrame, point_key: str, ts: str, intervals: DataFrame, title: str,
                          start: str, end: str, before: str, after: str,
                          titles: list[str]) -> DataFrame:
    """One 0/1 column per title: does the point lie in a padded interval of it?

    A sweep over points and interval ends in the order of time: both are
    range-partitioned together, and the number of open intervals of each title is
    carried from piece to piece.  An interval is two rows however long it is, a title
    with most intervals is many tasks, and many points of one time are, too, as ends
    come before and after all of them.  A point without a time lies in none.
    """
    padded = intervals.select(
        F.col(title).alias("_title"),
        (F.col(start) - F.expr(f"interval {before}")).alias("_lo"),
        (F.col(end) + F.expr(f"interval {after}")).alias("_hi"),
    ).where(F.col("_title").isin(titles))
    row = F.struct(*points.columns)
    steps = [f"_step{i}" for i in range(len(titles))]
    edges = _edges(padded, ["_title"], "_lo", "_hi").select(
        "_at", "_side", *[F.when(F.col("_title") == t, F.col("_step")).otherwise(0).alias(s) for t, s in zip(titles, steps)], F.lit(0).cast("bigint").alias("_salt"))
    marks = points.select(F.col(ts).alias("_at"), F.lit(1).alias("_side"), *[F.lit(0).cast("bigint").alias(s) for s in steps],
                          F.xxhash64(point_key).alias("_salt"), row.alias("_row"))
    swept = running_totals(marks.unionByName(edges, allowMissingColumns=True), ["_at", "_side", "_salt"], {s: f"_open{i}" for i, s in enumerate(steps)})
    flags = [(F.col("_at").isNotNull() & (F.col(f"_open{i}") > 0)).cast("int").alias(t) for i, t in enumerate(titles)]
    return swept.where("_side = 1").select("_row.*", *flags)


def flag_active_few(points: DataFrame, ts: str, intervals: DataFrame, title: str, start: str, end: str,
                    before: str, after: str, titles: list[str]) -> DataFrame:
    """:func:`flag_active_intervals` for a handful of intervals, such as literals.

    The padded intervals travel as one short array that every row tests, so the
    points are read once and nothing is shuffled.  For a table of intervals use the join.
    """
    padded = intervals.select(F.struct(F.col(title).alias("t"), (F.col(start) - F.expr(f"interval {before}")).alias("lo"), (F.col(end) + F.expr(f"interval {after}")).alias("hi")).alias("i"))
    every = padded.agg(F.collect_list("i")).scalar()
    rows = points.withColumn("_every", every)
    flag = lambda t: F.exists("_every", lambda i: (i["t"] == t) & F.col(ts).between(i["lo"], i["hi"]))
    return rows.select(*points.columns, *[F.coalesce(flag(t).cast("int"), F.lit(0)).alias(t) for t in titles])


def compare_periods(df: DataFrame, period: str, first, second, keys: list[str], value: str,
                    base: Column | None = None) -> DataFrame:
    """Change ratio of ``value`` between two periods, optionally divided by the
    ratio of the base row(s) selected by ``base``.

    Both periods come from one conditional aggregate; no self join is needed.
    """
    def total(p):
        return F.sum(F.when(F.col(period) == p, F.col(value)))

    both = df.filter(F.col(period).isin(first, second))
    out = (both.groupBy(*keys).agg(total(first).alias("value_0"), total(second).alias("value_1"))
           .filter(F.col("value_0").isNotNull() & F.col("value_1").isNotNull())
           .withColumn("ratio", F.try_divide("value_1", "value_0")))
    if base is not None:
        national = both.filter(base).agg(F.try_divide(total(second), total(first))).scalar()
        out = out.withColumn("relative_ratio", F.try_divide(F.col("ratio"), national))
    return out
