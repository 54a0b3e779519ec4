"""Long, wide and nested layouts."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import join_keys

def time_spine(spark: SparkSession, minutes: int, days: int = 7) -> DataFrame:
    """Every slot of every weekday with a running index: ``dow``, ``slot``, ``idx``."""
    per_day = 24 * 60 // minutes
    return spark.range(days * per_day).select(
        F.floor(F.col("id") / per_day).cast("int").alias("dow"), (F.col("id") % per_day * minutes).cast("int").alias("slot"),
        F.col("id").cast("int").alias("idx"))


def slot_vector(means: DataFrame, entity: str, index: str, value: str, size: int) -> DataFrame:
    """Sparse ``(entity, index, value)`` rows as one vector per entity, 0 where empty.

    A group holds at most ``size`` entries, so collecting it is bounded.
    """
    filled = means.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(index, value))).alias("_m"))
    return filled.select(entity, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(
        F.try_element_at(F.col("_m"), i), F.lit(0.0))).alias("vector"))


def pivot_profile(df: DataFrame, entity: str, dow: str, slot: str, value: str, minutes: int) -> DataFrame:
    """Mean per entity, weekday and slot laid out as a vector of 7 days."""
    per_day = 24 * 60 // minutes
    idx = (F.col(dow) * per_day + F.floor(F.col(slot) / minutes)).cast("int")
    means = df.groupBy(entity, idx.alias("idx")).agg(F.avg(value).cast("double").alias("v"))
    return slot_vector(means, entity, "idx", "v", 7 * per_day)


def pivot_long_series(df: DataFrame, entity: str, date_idx: str, time_idx: str, value: str) -> DataFrame:
    """Entity by absolute slot, kept long: weekly averaging is not applied."""
    return df.groupBy(entity, date_idx, time_idx).agg(F.avg(value).alias("value"))


def standardise_vectors(vectors: DataFrame, entity: str, vector: str) -> DataFrame:
    """Every position to mean 0 and population deviation 1 across entities."""
    long = vectors.select(entity, F.posexplode(vector).alias("idx", "value"))
    stats = long.groupBy("idx").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    return long.join(stats, "idx").select(
        entity, "idx", F.when(F.col("_sd") > 0, (F.col("value") - F.col("_mean")) / F.col("_sd")).otherwise(0.0).alias("value"))


def with_group_means(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Row-level features with the mean of their group joined back.

    Means are aggregated and joined: a window would pull a hot group into one task.
    A NULL group is a group.
    """
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return join_keys(df, means, group)


def pivot_table(df: DataFrame, row: str, column: str, values: list, value: str, how=F.avg) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(how(value))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def repivot(long: DataFrame, ids: list[str], name: str, values: list[str], value: str) -> DataFrame:
    return long.groupBy(*ids).pivot(name, values).agg(F.first(value, ignorenulls=True))


def series_by_weekday(df: DataFrame, entity: str, dow: str, slot: str, value: str) -> DataFrame:
    """Per entity a map from weekday to its values in slot order (bounded by the slots of a week)."""
    means = df.groupBy(entity, dow, slot).agg(F.avg(value).alias("_v"))
    days = means.groupBy(entity, dow).agg(F.transform(F.array_sort(F.collect_list(F.struct(slot, "_v"))), lambda s: s["_v"]).alias("_s"))
    return days.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(dow, "_s")))).alias("series"))


def vectors_to_daily(df: DataFrame, keys: list[str], year: str, vector: str) -> DataFrame:
    """One row per day of a yearly vector; gaps are left out."""
    long = df.select(*keys, year, F.posexplode(vector).alias("day", "value")).filter(F.col("value").isNotNull())
    return long.withColumn("date", F.date_add(F.make_date(F.col(year), F.lit(1), F.lit(1)), F.col("day")))


def columns_to_vector(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Many columns as one vector; NULL and NaN become 0."""
    clean = df.select(*[c for c in df.columns if c not in columns],
                      *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    return VectorAssembler(inputCols=columns, outputCol=out).transform(clean)


def zscore(df: DataFrame, columns: list[str], fit_on: Column | None = None) -> DataFrame:
    """Mean 0 and population deviation 1; parameters may come from some rows only."""
    base = df.filter(fit_on) if fit_on is not None else df
    params = base.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])

    def scaled(c):
        p = params.select(c).scalar()
        return F.try_divide(F.col(c) - p.getField("m"), p.getField("s")).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def fill_with_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return df.select(*[F.coalesce(F.col(c), means.select(c).scalar()).alias(c) if c in columns else F.col(c) for c in df.columns])
