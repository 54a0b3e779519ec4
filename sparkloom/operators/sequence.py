"""Ordered computations that never put a whole table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.timeparts import time_bucket
from sparkloom.runtime import global_row_number, join_keys, neighbour_in_order, running_total


def _running_share(hist: DataFrame, order: str, value: Column) -> Column:
    # Default RANGE frame: ties share a value, as in a plain ordered window sum.
    w = Window.orderBy(F.desc(order))
    return F.sum(value).over(w) / F.sum(value).over(Window.partitionBy())


def cumulative_pct(bridge: DataFrame, entity: str, other: str) -> DataFrame:
    """Share of entities, and of all their occurrences, covered when entities are
    taken in order of how many distinct ``other`` values they have.

    The window runs over the histogram of counts.  Its rows are distinct counts:
    m of them need at least m(m+1)/2 bridge rows, so it stays small at any scale.
    """
    counts = bridge.groupBy(entity).agg(F.countDistinct(other).alias("n"))
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("entities"))
    shares = hist.select(
        "n",
        F.round(_running_share(hist, "n", F.col("entities")) * 100, 4).alias("cum_entity_pct"),
        F.round(_running_share(hist, "n", F.col("entities") * F.col("n")) * 100, 4).alias("cum_pos_pct"))
    return counts.join(shares, "n").select(entity, "n", "cum_entity_pct", "cum_pos_pct")


def cumulative_pct_by_freq(bridge: DataFrame, dimension: DataFrame, entity: str, digits: int = 4) -> DataFrame:
    """Variant ordered by how many entities share a count; written back to the
    dimension with 0 for entities never seen."""
    counts = bridge.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("entities"))
    shares = hist.select("n", F.round(_running_share(hist, "entities", F.col("entities")), digits).alias("cum_pct"))
    known = counts.join(shares, "n").select(entity, "cum_pct")
    return dimension.join(known, entity, "left").withColumn("cum_pct", F.coalesce("cum_pct", F.lit(0.0)))


def covering(shares: DataFrame, percent: float) -> DataFrame:
    """Entities that together hold the given percentage of occurrences."""
    return shares.filter(F.col("cum_pos_pct") <= percent)


def dense_key(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Surrogate ids 1..n of the distinct key combinations, in key order."""
    return global_row_number(df.select(*columns).distinct(), columns, out)


def attach_dense_key(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Every row with the surrogate id of its key; a NULL is a value like any other."""
    return join_keys(df, dense_key(df, columns, out), columns)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by the 0-based rank of its value among the sorted values, NULL first."""
    for c in columns:
        codes = dense_key(df, [c], "_code").select(F.col(c), (F.col("_code") - 1).alias("_code"))
        df = join_keys(df, codes, [c]).drop(c).withColumnRenamed("_code", c)
    return df


def log_diff(df: DataFrame, keys: list[str], date: str, price: str, chunk: Column, out: str = "diff") -> DataFrame:
    """log(next price / price) per key in date order; NULL on the last date."""
    ahead = neighbour_in_order(df, keys, [date], chunk, {price: "_next"}, forward=True)
    return ahead.withColumn(out, F.log(F.try_divide("_next", price))).drop("_next")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group.  Spark cuts each partition to ``n`` rows per
    group before the shuffle, so a group of any size is safe."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def empirical_cdf(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the share of rows not above each of them.

    Values are counted first and then summed in range partitions, so neither a
    frequent value nor the size of the table makes a large task.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(column)).scalar()
    run = running_total(counts, ["value"], "n", "_run")
    return run.select("value", "n", (F.col("_run") / total).alias("cdf"))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Linear-interpolation quantiles, one row per share, from ordered value counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    run = running_total(counts, ["value"], "n", "_run")
    total = df.agg(F.count(column)).scalar()
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    ranked = run.withColumn("_last", total - 1).withColumn("_start", F.col("_run") - F.col("n"))

    def inside(spot):
        return (spot >= F.col("_start")) & (spot < F.col("_run"))

    # A value's rows have the 0-based ranks [_start, _run); only the few values
    # that hold a wanted rank go on.
    here = F.filter(wanted, lambda s: inside(F.floor(s * F.col("_last"))) | inside(F.ceil(s * F.col("_last"))))
    holds = ranked.withColumn("_share", F.explode(here)).withColumn("_pos", F.col("_share") * F.col("_last"))
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    lower = F.max(F.when(inside(lo), F.col("value")))
    upper = F.max(F.when(inside(hi), F.col("value")))
    rest = F.first(F.col("_pos") - F.floor("_pos"))
    return holds.groupBy(F.col("_share").alias("share")).agg((lower + (upper - lower) * rest).alias("value"))


def entity_timeline(df: DataFrame, entity: str, ts: str, tie: str) -> DataFrame:
    """Events of each entity with the time of the one before."""
    hours = time_bucket(F.col(ts), 60)  # even an entity with most rows is cut into hours
    return neighbour_in_order(df, [entity], [ts, tie], hours, {ts: "previous_ts"})


def adjacent_equal(array: Column, value) -> Column:
    """True if the array has ``value`` directly followed by ``value``."""
    pairs = F.arrays_zip(F.slice(array, 1, F.greatest(F.size(array) - 1, F.lit(0))).alias("a"),
                         F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))).alias("b"))
    return F.exists(pairs, lambda p: (p["a"] == value) & (p["b"] == value))


def running_share(df: DataFrame, index: str, value: str) -> DataFrame:
    """Cumulative share of a bounded list of eigenvalues, in index order."""
    w = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum_share", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy()))
