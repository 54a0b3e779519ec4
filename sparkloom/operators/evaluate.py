"""Splits, folds, baselines and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.select import hash_share
from sparkloom.runtime import cut_lineage, global_row_number, join_keys



def split_random(df: DataFrame, key: str, test_share: float) -> DataFrame:
    """Seedless split by a hash of the key: the same rows on every run."""
    return df.withColumn("is_test", hash_share(F.col(key)) >= 1 - test_share)


def split_by_date(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    return df.withColumn("is_test", F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def week_folds(date: Column, test_start: str, weeks: int) -> Column:
    """Fold w: the 7 days ending w weeks before the day before the test; -1 otherwise."""
    back = F.datediff(F.date_sub(F.lit(test_start).cast("date"), 1), date)
    return F.when((back >= 0) & (back < weeks * 7), F.floor(back / 7).cast("int")).otherwise(-1)


def holdout_fold(date: Column, start: str, end: str) -> Column:
    return F.when(date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), 0).otherwise(-1)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    """Every label dealt evenly to the folds in hash order.

    Ranks come from one global order, so a label holding most rows is no hot task.
    A NULL label is a stratum of its own.
    """
    order = ["_label", "_hash", key]
    keyed = df.withColumn("_label", F.col(label)).withColumn("_hash", F.md5(F.col(key).cast("string")))
    ranked = global_row_number(keyed, order, "_rn")
    first = ranked.groupBy("_label").agg(F.min("_rn").alias("_first"))
    return join_keys(ranked, first, ["_label"]).withColumn("fold", ((F.col("_rn") - F.col("_first")) % folds).cast("int")).drop(
        "_label", "_hash", "_rn", "_first")


def downsample_negatives(df: DataFrame, key: str, label: str, ratio: float) -> DataFrame:
    """All positives and exactly ``ratio`` times as many negatives, in hash order.

    Left as it is unless negatives outnumber positives by more than ``ratio``.
    """
    n = df.agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    if n.pos == 0 or n.neg / n.pos <= ratio:
        return df
    negatives = df.filter(F.col(label) == 0).withColumn("_hash", F.md5(F.col(key).cast("string")))
    kept = global_row_number(negatives, ["_hash", key], "_rn").filter(F.col("_rn") <= int(n.pos * ratio))
    return df.filter(F.col(label) > 0).unionByName(kept.select(*df.columns))


def baseline_predict(train: DataFrame, test: DataFrame, keys: list[str], label: str, out: str) -> DataFrame:
    """Half-even rounded mean per key set, 0 for combinations never seen."""
    means = train.groupBy(*keys).agg(F.bround(F.avg(label), 0).cast("int").alias(out))
    return test.join(means, keys, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def two_stage(binary: Column, level: Column) -> Column:
    """The level prediction where the binary model says 1, else 0."""
    return F.when(binary == 1, F.coalesce(level, F.lit(0))).otherwise(0)


def attach_predictions(template: DataFrame, predictions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return template.join(predictions.select(*keys, *columns), keys, "left").na.fill(0, columns)


def confusion(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def normalised_confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    cells = confusion(df, actual, predicted)
    rows = cells.groupBy(actual).agg(F.sum("n").alias("_t"))
    return cells.join(rows, actual).select(actual, predicted, "n", (F.col("n") / F.col("_t")).alias("share"))


def top_confusions(df: DataFrame, actual: str, predicted: str, n: int) -> DataFrame:
    return confusion(df, actual, predicted).filter(F.col(actual) != F.col(predicted)).orderBy(
        F.desc("n"), actual, predicted).limit(n)


def binary_rates(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    c = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))
    return c.select("*", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
                    F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def metrics_by_group(df: DataFrame, actual: str, predicted: str, group: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 per group and for all rows.

    Everything follows from one count per (group, actual, predicted); a class with
    no predictions or no rows scores 0, as usual for macro averages.
    """
    cells = cut_lineage(confusion(df, actual, predicted, [group]).withColumn(group, F.col(group).cast("string")))
    cells = cells.unionByName(cells.groupBy(actual, predicted).agg(F.sum("n").alias("n")).withColumn(group, F.lit("all")))
    sides = F.array(
        F.struct(F.col(actual).alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(predicted).alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")))
    per = cells.select(group, F.explode(sides).alias("s")).groupBy(group, "s.c").agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hit").alias("hit"))
    p = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    macro = per.groupBy(group).agg(F.round(F.avg(p), 3).alias("precision"), F.round(F.avg(r), 3).alias("recall"), F.round(F.avg(f1), 3).alias("f1_score"))
    plain = cells.groupBy(group).agg(
        F.sum("n").alias("count"),
        F.round(F.sum(F.when(F.col(actual) == 0, F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("pct_negative"),
        F.round(F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("accuracy"))
    return plain.join(macro, group).orderBy(F.desc("count"), group)


def cluster_scores(df: DataFrame, cluster: str, actual: str, models: dict[str, str]) -> DataFrame:
    """Accuracy of several prediction columns per cluster, in one pass; a few rows, kept."""
    hits = [F.avg((F.col(actual) == F.col(c)).cast("int")).alias(name) for name, c in models.items()]
    wide = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *hits)
    return cut_lineage(wide).unpivot([cluster, "size"], list(models), "model", "score")


def best_model_per_cluster(scores: DataFrame, cluster: str) -> DataFrame:
    """Highest score strictly above 0; equal scores go to the first name."""
    ranked = scores.filter(F.col("score") > 0).groupBy(cluster).agg(F.min(F.struct((-F.col("score")).alias("s"), "model")).alias("m"))
    return ranked.select(cluster, F.col("m.model").alias("model"), (-F.col("m.s")).alias("score"))


def weighted_overall(scores: DataFrame) -> DataFrame:
    """Cluster scores weighted by cluster size, per model."""
    return scores.groupBy("model").agg((F.sum(F.col("score") * F.col("size")) / F.sum("size")).alias("score"))


def ensemble_pick(df: DataFrame, best: DataFrame, cluster: str, models: dict[str, str], out: str) -> DataFrame:
    """Each row takes the prediction of its cluster's best model."""
    joined = df.join(best.select(cluster, F.col("model").alias("_best")), cluster, "left")
    pick = F.lit(None)
    for name, column in models.items():
        pick = F.when(F.col("_best") == name, F.col(column)).otherwise(pick)
    return joined.withColumn(out, F.coalesce(pick, F.lit(0))).drop("_best")


def binarise(column: Column, target) -> Column:
    return F.when(column == target, 1.0).otherwise(0.0)


def error_rate(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) != F.col(predicted)).cast("int")).alias("error"))
