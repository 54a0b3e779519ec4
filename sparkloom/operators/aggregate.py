"""Grouped aggregates.  Partial aggregation on the map side keeps hot keys cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.linalg import pair_moments
from sparkloom.runtime import materialise


def sales_by(sale: DataFrame, keys: list[str], items: str, sales: str) -> DataFrame:
    return sale.groupBy(*keys).agg(F.sum("quantity").alias(items),
                                   F.round(F.sum(F.col("quantity") * F.col("price")), 2).alias(sales))


def top_entities(sale: DataFrame, key: str, n: int) -> DataFrame:
    return sales_by(sale, [key], "qty", "sales").orderBy(F.desc("sales"), key).limit(n)


def max_of_sums(df: DataFrame, outer: list[str], inner: list[str], measures: dict[str, str]) -> DataFrame:
    """``max(sum(x))`` written as two levels."""
    sums = df.groupBy(*outer, *inner).agg(*[F.sum(c).alias(c) for c in measures])
    return sums.groupBy(*outer).agg(*[F.max(c).alias(out) for c, out in measures.items()])


def league_points(teams: DataFrame, matches: DataFrame) -> DataFrame:
    """Home win 2, away win 3, tie 1 each; teams without points get 0."""
    earned = matches.select(F.explode(point_awards("home", "away", "home_score", "away_score")).alias("_e"))
    sums = earned.groupBy(F.col("_e.name").alias("name")).agg(F.sum("_e.points").alias("points"))
    return teams.join(sums, "name", "left").select("name", F.coalesce("points", F.lit(0).cast("bigint")).alias("points"))


def point_awards(home: str, away: str, home_score: str, away_score: str) -> Column:
    """Array of ``(name, points)`` earned in one match."""
    def award(name, points):
        return F.struct(F.col(name).alias("name"), F.lit(points).cast("bigint").alias("points"))

    h, a = F.col(home_score), F.col(away_score)
    return (F.when(h > a, F.array(award(home, 2))).when(h < a, F.array(award(away, 3)))
            .when(h == a, F.array(award(home, 1), award(away, 1))))


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """Exact distinct values per column; grouping precedes counting, so no set is held in one task."""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def approximate_distinct(df: DataFrame, *columns: str, error: float = 0.02) -> DataFrame:
    return df.agg(*[F.approx_count_distinct(c, error).alias(f"n_{c}") for c in columns])


def level_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min_level"), F.max(value).alias("max_level"),
                                 F.avg(value).alias("avg_level"), F.count(value).alias("n"))


def mean_of_daily_max(df: DataFrame, entity: str, date: str, dow: str, slot: str, value: str) -> DataFrame:
    """Maximum per day and slot, then its mean over the days of each weekday."""
    daily = df.groupBy(entity, date, dow, slot).agg(F.max(value).alias("_m"))
    return daily.groupBy(entity, dow, slot).agg(F.avg("_m").alias("share"))


def entity_lifespan(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """First and last appearance, count and minutes between them."""
    life = df.groupBy(entity).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return life.withColumn("minutes", F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")) / 60.0)


def values_per_entity_histogram(df: DataFrame, entity: str, value: str) -> DataFrame:
    """How many entities have 1, 2, 3... distinct values."""
    per = df.groupBy(entity).agg(F.countDistinct(value).alias("n_values"))
    return per.groupBy("n_values").agg(F.count(F.lit(1)).alias("n_entities"))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency table with shares of the total, most frequent first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    out = counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), F.col(column))
    return out.limit(n) if n else out


def sum_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key)


def avg_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(key)


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column: mean, sample deviation, extremes, missing."""
    packed = df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("min"),
                 F.max(c).cast("double").alias("max"), F.count_if(F.col(c).isNull()).alias("missing")).alias(c)
        for c in columns])
    stacked = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return packed.select(F.explode(stacked).alias("r")).select("r.column", "r.s.*")


def profile_text(df: DataFrame, columns: list[str], n: int = 3) -> DataFrame:
    """Per text column: distinct, missing, and the ``n`` most and least common values.

    All columns are counted in one grouped pass over ``(column, value)``, the only one
    that reads the table; ranks are cut to ``n`` per column before any shuffle.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r"))
    counts = materialise(long.groupBy("r.column", "r.value").agg(F.count(F.lit(1)).alias("n")), "values")
    known = counts.filter(F.col("value").isNotNull())
    most = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    least = Window.partitionBy("column").orderBy("n", "value")
    top = known.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= n).withColumn("kind", F.lit("most"))
    low = known.withColumn("rank", F.row_number().over(least)).filter(F.col("rank") <= n).withColumn("kind", F.lit("least"))
    facts = counts.groupBy("column").agg(
        F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return top.unionByName(low).join(facts, "column")


def find_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .withColumn("surplus", F.col("n") - 1))


def entity_rate(df: DataFrame, entity: str, part: str, whole: str) -> DataFrame:
    """Sum of parts over sum of wholes per entity; the global rate where the whole is 0."""
    overall = df.agg(F.try_divide(F.sum(part), F.sum(whole))).scalar()
    rates = df.groupBy(entity).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("_rate"))
    return rates.select(entity, F.coalesce("_rate", overall).alias("rate"))


def attach_rate(df: DataFrame, rates: DataFrame, entity: str, overall: Column) -> DataFrame:
    """Rates joined to (possibly unseen) entities, which get the global rate."""
    return df.join(rates, entity, "left").withColumn("rate", F.coalesce("rate", overall))


def review_counts(df: DataFrame, entity: str, rated: Column) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(rated).alias("n_rated")).withColumn(
        "rated_share", F.col("n_rated") / F.col("n_total"))


def null_report(df: DataFrame) -> DataFrame:
    """One row per column: number of NULLs and whether there is any."""
    packed = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return packed.select(F.explode(pairs).alias("r")).select("r.column", "r.nulls", (F.col("r.nulls") > 0).alias("any_null"))


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance and Pearson correlation of every column pair (x, y), by sums of products of whole rows."""
    found = pair_moments(df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v")), "v", len(columns))
    names = F.lit(list(columns))
    return found.select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), "cov", "corr")


def moments(df: DataFrame, column: str, shares: tuple[float, ...] = (0.001, 0.01, 0.99, 0.999),
            accuracy: int = 10000) -> DataFrame:
    """Count, mean, population deviation and approximate tail percentiles."""
    tails = F.percentile_approx(column, F.array(*[F.lit(s) for s in shares]), accuracy)
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), tails.alias("_t"))
    names = [f"p{str(s).replace('0.', '')}" for s in shares]
    return out.select("n", "mean", "sd", *[F.col("_t")[i].alias(nm) for i, nm in enumerate(names)])


def bounding_box(df: DataFrame, lat: str, lon: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
                                         F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"))


def group_means(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def neg_pos_ratio(label: Column) -> Column:
    """Negatives per positive, 1 digit; 99999 without positives (fixed value)."""
    pos, neg = F.count_if(label == 1), F.count_if(label == 0)
    return F.when(pos == 0, F.lit(99999.0)).otherwise(F.round(F.try_divide(neg, pos), 1))


def pct_negative(label: Column) -> Column:
    return F.round(F.count_if(label == 0) / F.count(label), 3)


def row_gap_histogram(df: DataFrame, array: str) -> DataFrame:
    """How many rows have 0, 1, 2... missing entries in their vector."""
    gaps = F.size(F.filter(array, lambda x: x.isNull() | F.isnan(x)))
    return df.groupBy(gaps.alias("n_gaps")).agg(F.count(F.lit(1)).alias("n_rows"))


def yearly_extremes(df: DataFrame, year: str, value: str) -> DataFrame:
    return df.groupBy(year).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def extreme_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys holding the smallest and the largest value; ties go to the smaller key."""
    return df.agg(F.min(F.struct(F.col(value), F.col(key))).getField(key).alias("key_of_min"),
                  F.min(F.struct((-F.col(value)).alias("v"), F.col(key))).getField(key).alias("key_of_max"))


def totals_by_flow(df: DataFrame, date: str, flow: str, value: str, flows: list) -> DataFrame:
    """Daily totals with one column per flow."""
    return df.groupBy(date).pivot(flow, flows).agg(F.sum(value)).na.fill(0)


def letter_shares(words: DataFrame, word: str) -> DataFrame:
    """Share of each second letter among the words of each first letter, 3 digits."""
    letters = words.filter(F.length(word) >= 2).select(
        F.substring(word, 1, 1).alias("first"), F.substring(word, 2, 1).alias("second"))
    counts = letters.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("first").agg(F.sum("n").alias("total"))
    return counts.join(totals, "first").select("first", "second", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))

