"""Splits, folds, baselines and evaluation tables on the modelling grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import evaluate
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import REPORT_SQL, grid, report, text
from sparkloom.runtime import materialise

TEST_START, TEST_END = "2024-01-22", "2024-01-28"

GRID_SQL = "WITH " + REPORT_SQL + """, fact AS (SELECT bucket, segment_id, max(level) AS level, count(*) AS n FROM report GROUP BY ALL),
grid AS (SELECT s.segment_id, b.bucket, dow, slot, coalesce(f.level, 0) AS level, least(1, coalesce(f.n, 0))::INTEGER AS level_binary,
  (s.segment_id % 4)::INTEGER AS cluster, b.bucket::DATE BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' AS is_test
  FROM (SELECT DISTINCT segment_id FROM report) s CROSS JOIN (SELECT DISTINCT bucket, dow, slot FROM report) b
  LEFT JOIN fact f ON f.segment_id = s.segment_id AND f.bucket = b.bucket),
test AS (SELECT * FROM grid WHERE is_test),
m1 AS (SELECT slot, cluster, dow, round_even(avg(level), 0)::INTEGER AS p FROM grid WHERE NOT is_test AND level > 0 GROUP BY ALL),
m2 AS (SELECT cluster, slot // 240 AS part, round_even(avg(level), 0)::INTEGER AS p FROM grid WHERE NOT is_test AND level > 0 GROUP BY ALL),
m3 AS (SELECT segment_id, slot // 240 AS part, round_even(avg(level_binary) * 6, 0)::INTEGER AS p FROM grid WHERE NOT is_test GROUP BY ALL),
preds AS (SELECT t.*, coalesce(m1.p, 0) AS by_slot, coalesce(m2.p, 0) AS by_cluster, least(1, coalesce(m3.p, 0)) AS busy,
  CASE WHEN least(1, coalesce(m3.p, 0)) = 1 THEN coalesce(m2.p, 0) ELSE 0 END AS staged
  FROM test t LEFT JOIN m1 ON m1.slot = t.slot AND m1.cluster = t.cluster AND m1.dow = t.dow
  LEFT JOIN m2 ON m2.cluster = t.cluster AND m2.part = t.slot // 240 LEFT JOIN m3 ON m3.segment_id = t.segment_id AND m3.part = t.slot // 240)
"""


def tagged_grid(t: Tables) -> DataFrame:
    g = grid(t).withColumn("cluster", (F.col("segment_id") % 4).cast("int")).withColumn("date", F.to_date("bucket"))
    return evaluate.split_by_date(g, "date", TEST_START, TEST_END)


def predictions(t: Tables) -> DataFrame:
    """Three simple models and their two-stage combination on the test week."""
    g = materialise(tagged_grid(t).withColumn("part", F.floor(F.col("slot") / 240)), "grid")
    train, test = g.filter("NOT is_test"), g.filter("is_test")
    positive = train.filter("level > 0")
    out = evaluate.baseline_predict(positive, test, ["slot", "cluster", "dow"], "level", "by_slot")
    out = evaluate.baseline_predict(positive, out, ["cluster", "part"], "level", "by_cluster")
    scaled = train.withColumn("six", F.col("level_binary") * 6)
    out = evaluate.baseline_predict(scaled, out, ["segment_id", "part"], "six", "busy")
    out = out.withColumn("busy", F.least(F.lit(1), F.col("busy")))
    return out.withColumn("staged", evaluate.two_stage(F.col("busy"), F.col("by_cluster")))


@query(GRID_SQL + "SELECT segment_id, bucket::VARCHAR AS bucket, level, by_slot, by_cluster, busy, staged FROM preds")
def baseline_predictions(t: Tables) -> DataFrame:
    return text(predictions(t).select("segment_id", "bucket", "level", "by_slot", "by_cluster", "busy", "staged"))


_MACRO_SQL = """, c0 AS (SELECT cluster::VARCHAR AS cluster, {y} AS y, {p} AS p, count(*) AS n FROM preds GROUP BY ALL),
c AS (SELECT * FROM c0 UNION ALL SELECT 'all', y, p, sum(n)::BIGINT FROM c0 GROUP BY y, p),
k AS (SELECT cluster, y AS c FROM c UNION SELECT cluster, p FROM c),
s AS (SELECT k.cluster, k.c, coalesce(sum(n) FILTER (WHERE y = k.c AND p = k.c), 0) AS hit, coalesce(sum(n) FILTER (WHERE y = k.c), 0) AS sup,
  coalesce(sum(n) FILTER (WHERE p = k.c), 0) AS gue FROM k JOIN c ON c.cluster = k.cluster GROUP BY ALL),
f AS (SELECT cluster, coalesce(hit / nullif(gue, 0), 0) AS pr, coalesce(hit / nullif(sup, 0), 0) AS re FROM s),
a AS (SELECT cluster, round(avg(pr), 3) AS precision, round(avg(re), 3) AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 3) AS f1_score FROM f GROUP BY 1)
SELECT c.cluster, sum(n)::BIGINT AS count, round(coalesce(sum(n) FILTER (WHERE y = 0), 0) / sum(n), 3) AS pct_negative,
  round(coalesce(sum(n) FILTER (WHERE y = p), 0) / sum(n), 3) AS accuracy, any_value(precision) AS precision, any_value(recall) AS recall, any_value(f1_score) AS f1_score
FROM c JOIN a ON a.cluster = c.cluster GROUP BY c.cluster"""


@query(GRID_SQL + _MACRO_SQL.format(y="level", p="staged"))
def metrics_by_cluster(t: Tables) -> DataFrame:
    return evaluate.metrics_by_group(predictions(t), "level", "staged", "cluster")


@query(GRID_SQL + _MACRO_SQL.format(y="level_binary", p="busy"))
def binary_metrics_by_cluster(t: Tables) -> DataFrame:
    return evaluate.metrics_by_group(predictions(t), "level_binary", "busy", "cluster")


@query(GRID_SQL + """SELECT level, by_cluster, n, round(n / sum(n) OVER (PARTITION BY level), 6) AS share FROM (SELECT level, by_cluster, count(*) AS n FROM preds GROUP BY ALL)""")
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.normalised_confusion(predictions(t), "level", "by_cluster").withColumn("share", F.round("share", 6))


@query(GRID_SQL + "SELECT level, staged, count(*) AS n FROM preds WHERE level <> staged GROUP BY ALL ORDER BY n DESC, level, staged LIMIT 5")
def top_confusions(t: Tables) -> DataFrame:
    return evaluate.top_confusions(predictions(t), "level", "staged", 5)


@query(GRID_SQL + """, c AS (SELECT count(*) FILTER (WHERE level_binary = 1 AND busy = 1) AS tp, count(*) FILTER (WHERE level_binary = 0 AND busy = 1) AS fp,
 count(*) FILTER (WHERE level_binary = 0 AND busy = 0) AS tn, count(*) FILTER (WHERE level_binary = 1 AND busy = 0) AS fn FROM preds)
SELECT tp, fp, tn, fn, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision FROM c""")
def binary_rates(t: Tables) -> DataFrame:
    out = evaluate.binary_rates(predictions(t), "level_binary", "busy")
    return out.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "precision")])


MODELS = {"by_cluster": "by_cluster", "by_slot": "by_slot", "staged": "staged"}
_SCORE_SQL = """, sc AS (SELECT cluster, count(*) AS size, avg((level = by_cluster)::INT) AS a, avg((level = by_slot)::INT) AS b, avg((level = staged)::INT) AS c FROM preds GROUP BY 1),
score AS (SELECT cluster, size, 'by_cluster' AS model, a AS score FROM sc UNION ALL SELECT cluster, size, 'by_slot', b FROM sc UNION ALL SELECT cluster, size, 'staged', c FROM sc),
best AS (SELECT cluster, model, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, model) AS r FROM score WHERE score > 0) WHERE r = 1)
"""


@query(GRID_SQL + _SCORE_SQL + "SELECT cluster, model, round(score, 6) AS score FROM best")
def best_model_per_cluster(t: Tables) -> DataFrame:
    scores = evaluate.cluster_scores(predictions(t), "cluster", "level", MODELS)
    return evaluate.best_model_per_cluster(scores, "cluster").withColumn("score", F.round("score", 6))


@query(GRID_SQL + _SCORE_SQL + "SELECT model, round(sum(score * size) / sum(size), 6) AS score FROM score GROUP BY model")
def weighted_overall(t: Tables) -> DataFrame:
    scores = evaluate.cluster_scores(predictions(t), "cluster", "level", MODELS)
    return evaluate.weighted_overall(scores).withColumn("score", F.round("score", 6))


@query(GRID_SQL + _SCORE_SQL + """SELECT segment_id, bucket::VARCHAR AS bucket, CASE model WHEN 'by_cluster' THEN by_cluster WHEN 'by_slot' THEN by_slot ELSE staged END AS predicted
FROM preds LEFT JOIN best USING (cluster)""")
def ensemble_predictions(t: Tables) -> DataFrame:
    p = materialise(predictions(t), "predictions")
    best = evaluate.best_model_per_cluster(evaluate.cluster_scores(p, "cluster", "level", MODELS), "cluster")
    return text(evaluate.ensemble_pick(p, best, "cluster", MODELS, "predicted").select("segment_id", "bucket", "predicted"))


@query(GRID_SQL + "SELECT round(avg((level <> by_cluster)::INT), 6) AS error FROM preds")
def error_rate(t: Tables) -> DataFrame:
    return evaluate.error_rate(predictions(t), "level", "by_cluster").withColumn("error", F.round("error", 6))


@query(GRID_SQL + """SELECT g.segment_id, g.bucket::VARCHAR AS bucket, coalesce(p.staged, 0) AS staged FROM grid g LEFT JOIN preds p ON p.segment_id = g.segment_id AND p.bucket = g.bucket""")
def attach_predictions(t: Tables) -> DataFrame:
    """Predictions joined to the whole grid; rows without one get 0."""
    template = tagged_grid(t).select("segment_id", "bucket")
    return text(evaluate.attach_predictions(template, predictions(t), ["segment_id", "bucket"], ["staged"]))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS target FROM embeddings")
def binarise_label(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", evaluate.binarise(F.col("label"), 3).alias("target"))


@query("SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 >= 0.75 AS is_test FROM events")
def split_random(t: Tables) -> DataFrame:
    return evaluate.split_random(t.events.select("event_id"), "event_id", 0.25)


@query(f"SELECT event_id, ts::DATE BETWEEN DATE '{TEST_START}' AND DATE '{TEST_END}' AS is_test FROM events")
def split_by_date(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.to_date("ts").alias("date"))
    return evaluate.split_by_date(rows, "date", TEST_START, TEST_END).drop("date")


@query(f"""SELECT event_id, CASE WHEN b >= 0 AND b < 14 THEN (b // 7)::INTEGER ELSE -1 END AS fold, CASE WHEN d BETWEEN DATE '2024-01-15' AND DATE '2024-01-18' THEN 0 ELSE -1 END AS holdout
FROM (SELECT event_id, ts::DATE AS d, date_diff('day', ts::DATE, DATE '{TEST_START}' - 1) AS b FROM events)""")
def week_folds(t: Tables) -> DataFrame:
    d = F.to_date("ts")
    return t.events.select("event_id", evaluate.week_folds(d, TEST_START, 2).alias("fold"), evaluate.holdout_fold(d, "2024-01-15", "2024-01-18").alias("holdout"))


@query("""SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR), event_id) - 1) % 5)::INTEGER AS fold FROM events""")
def stratified_folds(t: Tables) -> DataFrame:
    return evaluate.stratified_folds(t.events.select("event_id", "event_type"), "event_id", "event_type", 5).select("event_id", "fold")


@query("WITH " + REPORT_SQL + """, r AS (SELECT event_id, (level >= 5)::INTEGER AS y FROM report)
SELECT event_id, y FROM r WHERE y = 1 UNION ALL (SELECT event_id, y FROM r WHERE y = 0 ORDER BY md5(event_id::VARCHAR), event_id LIMIT (SELECT 2 * count(*) FROM r WHERE y = 1))""")
def downsample_negatives(t: Tables) -> DataFrame:
    """Four negatives per positive are brought down to two."""
    rows = report(t).select("event_id", (F.col("level") >= 5).cast("int").alias("y"))
    return evaluate.downsample_negatives(rows, "event_id", "y", 2)
