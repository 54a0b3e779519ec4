"""Classifiers and regressions.

Moment-based models (Gaussian, discriminant, least squares) need one pass that
adds up outer products; the rest goes through ``pyspark.ml``.  Sweeps return
tables, one row per setting.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, IDF
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.arrays import clip
from sparkloom.operators.linalg import columns_of, matrix_of, outer_sums
from sparkloom.operators.trees import ExtraTrees
from sparkloom.runtime import cut_lineage, few_values


def as_points(df: DataFrame, vector: str, label: str, keep: list[str] | None = None, size: int | None = None) -> DataFrame:
    """``features`` and ``label`` columns for pyspark.ml; optionally the first ``size`` entries."""
    v = F.col(vector).cast("array<double>")
    return df.select(*(keep or []), array_to_vector(F.slice(v, 1, size) if size else v).alias("features"),
                     F.col(label).cast("double").alias("label"))


def accuracy(predicted: DataFrame, actual: str = "label", prediction: str = "prediction") -> float:
    return predicted.agg(F.avg((F.col(actual) == F.col(prediction)).cast("int"))).first()[0]


# ---- models from moments ---------------------------------------------------------

class ClassMoments:
    """Count, mean and second moment of each class; arrays of bounded size."""

    def __init__(self, labels, counts, means, second):
        self.labels, self.counts, self.means, self.second = labels, counts, means, second

    @property
    def log_prior(self) -> np.ndarray:
        return np.log(self.counts / self.counts.sum())

    def covariances(self) -> np.ndarray:
        return self.second - np.einsum("ki,kj->kij", self.means, self.means)

    def pooled(self) -> np.ndarray:
        return np.einsum("k,kij->ij", self.counts / self.counts.sum(), self.covariances())


def _class_partials(vector: str, label: str, size: int):
    def run(batches):
        sums = {}
        for b in batches:
            x = matrix_of(b.column(vector), size)
            x1 = np.hstack([np.ones((len(x), 1)), x])
            y = b.column(label).to_numpy(zero_copy_only=False)
            for c in np.unique(y):
                rows = x1[y == c]
                sums[c] = sums.get(c, 0.0) + rows.T @ rows
        for c, s in sums.items():
            yield pa.RecordBatch.from_pydict({
                "label": pa.array(np.full(size + 1, c), pa.int64()), "i": pa.array(np.arange(size + 1), pa.int32()),
                "s": pa.array(list(s), pa.list_(pa.float64()))})

    return run


def class_moments(df: DataFrame, vector: str, label: str, size: int) -> ClassMoments:
    """One pass; each partition hands on one small matrix per class.  Rows without a label teach nothing."""
    rows = df.filter((F.size(vector) == size) & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias(vector), F.col(label).cast("bigint").alias(label))
    parts = rows.mapInArrow(_class_partials(vector, label, size), "label bigint, i int, s array<double>")
    long = parts.select("label", "i", F.posexplode("s").alias("j", "v")).groupBy("label", "i", "j").agg(F.sum("v").alias("v"))
    long = cut_lineage(long)
    classes = few_values(long, "label")
    at = {c: k for k, c in enumerate(classes)}
    m = np.zeros((len(classes), size + 1, size + 1))
    y, i, j, v = columns_of(long.select("label", "i", "j", "v"))  # classes * size^2 numbers
    m[[at[c] for c in y], i, j] = v
    counts = m[:, 0, 0]
    return ClassMoments(np.array(classes), counts, m[:, 0, 1:] / counts[:, None], m[:, 1:, 1:] / counts[:, None, None])


def _score_rows(df: DataFrame, vector: str, scorer: Callable, labels: np.ndarray, size: int) -> DataFrame:
    others = [f for f in df.schema.fields if f.name != vector]
    names = [f.name for f in others] + ["predicted"]

    def run(batches):
        for b in batches:
            x = matrix_of(b.column(vector), size)
            best = labels[scorer(x).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in others] + [pa.array(best, pa.int64())], names=names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in others] + ["predicted bigint"])
    return df.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def gaussian_scorer(m: ClassMoments, c: float) -> Callable:
    """Log density of each class with covariance + c * identity, plus log prior."""
    cov = m.covariances() + c * np.eye(m.means.shape[1])
    inverse = np.linalg.inv(cov)
    offset = m.log_prior - 0.5 * np.linalg.slogdet(cov)[1]
    means = m.means

    def score(x):
        out = np.empty((len(x), len(means)))
        for k in range(len(means)):
            d = x - means[k]
            out[:, k] = offset[k] - 0.5 * np.einsum("ij,jk,ik->i", d, inverse[k], d)
        return out

    return score


def discriminant_scorer(m: ClassMoments, ridge: float = 1e-6) -> Callable:
    """Linear discriminant on the pooled covariance."""
    w = np.linalg.solve(m.pooled() + ridge * np.eye(m.means.shape[1]), m.means.T)
    b = m.log_prior - 0.5 * np.einsum("ki,ik->k", m.means, w)

    def score(x):
        return x @ w + b

    return score


def gaussian_generative(train: DataFrame, test: DataFrame, vector: str, label: str, size: int, c: float) -> DataFrame:
    m = class_moments(train, vector, label, size)
    return _score_rows(test, vector, gaussian_scorer(m, c), m.labels, size)


def tune_gaussian(train: DataFrame, valid: DataFrame, vector: str, label: str, size: int, values: list[float]) -> DataFrame:
    """Validation error for each c; the moments are gathered once."""
    m = class_moments(train, vector, label, size)
    rows = []
    for c in values:
        scored = _score_rows(valid.select(label, vector), vector, gaussian_scorer(m, c), m.labels, size)
        rows.append((float(c), 1.0 - accuracy(scored, label, "predicted")))
    return train.sparkSession.createDataFrame(rows, "c double, error double")


def lda_classifier(train: DataFrame, test: DataFrame, vector: str, label: str, size: int) -> DataFrame:
    m = class_moments(train, vector, label, size)
    return _score_rows(test, vector, discriminant_scorer(m), m.labels, size)


class Gram:
    """Sums of products of [1, features, target]: enough for every linear fit."""

    def __init__(self, matrix: np.ndarray, features: list[str]):
        self.matrix, self.features = matrix, features

    def fit(self, subset: list[str] | None = None) -> dict[str, float]:
        names = subset if subset is not None else self.features
        pick = [0] + [1 + self.features.index(f) for f in names]
        beta = np.linalg.lstsq(self.matrix[np.ix_(pick, pick)], self.matrix[pick, -1], rcond=None)[0]
        return dict(zip(["intercept", *names], beta.tolist()))

    def mse(self, model: dict[str, float]) -> float:
        beta = np.zeros(len(self.matrix))
        beta[0], beta[-1] = model["intercept"], -1.0
        for f in self.features:
            beta[1 + self.features.index(f)] = model.get(f, 0.0)
        return float(beta @ self.matrix @ beta / self.matrix[0, 0])


def gram(df: DataFrame, features: list[str], target: str) -> Gram:
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    n = len(columns)
    m = np.zeros((n, n))
    i, j, s = columns_of(outer_sums(df.select(F.array(*columns).alias("v")), "v", n).filter("i >= 0").select("i", "j", "s"))
    m[i, j] = m[j, i] = s
    return Gram(m, features)


def linear_prediction(model: dict[str, float]):
    out = F.lit(model["intercept"])
    for f, b in model.items():
        if f != "intercept":
            out = out + F.lit(b) * F.col(f)
    return out


def least_squares(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """Normal-equation fit with MSE and MAE on the test rows."""
    model = gram(train, features, target).fit()
    error = linear_prediction(model) - F.col(target)
    return test.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))


def ablation(train: Gram, valid: Gram, spark) -> DataFrame:
    """Validation MSE of the full model and without each feature; no data is read again."""
    rows = [("none", valid.mse(train.fit()))]
    for f in train.features:
        rows.append((f, valid.mse(train.fit([x for x in train.features if x != f]))))
    return spark.createDataFrame(rows, "removed string, mse double")


def backward_elimination(train: Gram, valid: Gram, spark) -> DataFrame:
    """Features dropped one by one as long as the validation error does not rise."""
    left = list(train.features)
    best = valid.mse(train.fit(left))
    rows = [(0, "none", best)]
    while len(left) > 1:
        options = [(valid.mse(train.fit([x for x in left if x != f])), f) for f in left]
        error, gone = min(options)
        if error > best:
            break
        best = error
        left.remove(gone)
        rows.append((len(rows), gone, best))
    return spark.createDataFrame(rows, "step int, removed string, mse double")


# ---- counts predicted through rates --------------------------------------------------

def scaled_count_mae(df: DataFrame, rate, total: str, actual: str) -> DataFrame:
    """MAE of rounded predictions: rate clipped to [0, 1] times the total."""
    predicted = F.bround(clip(rate, 0.0, 1.0) * F.col(total), 0)
    return df.agg(F.avg(F.abs(predicted - F.col(actual))).alias("mae"))


def elastic_net_path(g: Gram, alphas: list[float], mix: float = 0.5, tolerance: float = 1e-12) -> dict[float, dict[str, float]]:
    """Elastic-net fits for all strengths from one set of sums, in the library's scaling.

    With features divided by their deviations it minimises half the mean squared error
    plus alpha * mix * |b|_1 + alpha * (1 - mix) / (2 s) * |b|^2, s the target's deviation.
    Coordinate descent, from the strongest penalty down, each start at the last solution;
    it ends when no coefficient moves by ``tolerance`` of the target's deviation.
    """
    n = g.matrix[0, 0]
    mean = g.matrix[0, 1:] / n
    cov = g.matrix[1:, 1:] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 0.0) * n / max(n - 1, 1))
    deviation[deviation < 1e-12 * np.maximum(1.0, np.abs(mean))] = 0.0
    scale, spread = deviation[:-1], deviation[-1]
    used = np.flatnonzero(scale)
    a = cov[np.ix_(used, used)] / np.outer(scale[used], scale[used])
    b = cov[used, -1] / scale[used]
    beta, found = np.zeros(len(used)), {}
    for alpha in sorted(alphas, reverse=True):
        first, second = alpha * mix, alpha * (1 - mix) / spread if spread else 0.0
        moved = math.inf
        while moved > tolerance * spread and spread:
            moved = 0.0
            for j in range(len(used)):
                pull = b[j] - a[j] @ beta + a[j, j] * beta[j]
                new = math.copysign(max(abs(pull) - first, 0.0), pull) / (a[j, j] + second)
                moved, beta[j] = max(moved, abs(new - beta[j])), new
        slopes = np.zeros(len(scale))
        slopes[used] = beta / scale[used]
        found[alpha] = {"intercept": float(mean[-1] - slopes @ mean[:-1]), **dict(zip(g.features, slopes.tolist()))}
    return {alpha: found[alpha] for alpha in alphas}


def elastic_net_sweep(train: DataFrame, test: DataFrame, features: list[str], total: str, actual: str,
                      alphas: list[float], mix: float = 0.5) -> DataFrame:
    """MAE on rounded counts for each regularisation strength; training rows are read once, test rows once."""
    rate = F.try_divide(F.col(actual).cast("double"), F.col(total).cast("double"))
    path = elastic_net_path(gram(train.withColumn("_rate", rate).where("_rate is not null"), features, "_rate"), alphas, mix)
    known = test.where(rate.isNotNull())
    guess = [F.bround(clip(linear_prediction(path[a]), 0.0, 1.0) * F.col(total), 0) for a in alphas]
    wide = known.agg(*[F.avg(F.abs(p - F.col(actual))).alias(f"m{i}") for i, p in enumerate(guess)])
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"m{i}").alias("mae")) for i, a in enumerate(alphas)]))
    return wide.select(each.alias("r")).select("r.alpha", "r.mae")


def split_regression(train: DataFrame, test: DataFrame, features: list[str], total: str, actual: str,
                     thresholds: list[float]) -> DataFrame:
    """One linear model on each side of a threshold of ``total``; each side is predicted by its own."""
    rated = train.filter(F.col(total) > 0).withColumn("_rate", F.col(actual) / F.col(total))
    rows = []
    for cut in thresholds:
        low = gram(rated.filter(F.col(total) <= cut), features, "_rate").fit()
        high = gram(rated.filter(F.col(total) > cut), features, "_rate").fit()
        rate = F.when(F.col(total) <= cut, linear_prediction(low)).otherwise(linear_prediction(high))
        rows.append((float(cut), scaled_count_mae(test, rate, total, actual).first()[0]))
    return train.sparkSession.createDataFrame(rows, "threshold double, mae double")


# ---- pyspark.ml sweeps ------------------------------------------------------------------

def gathered(cached: DataFrame, each: int = 128 << 20) -> DataFrame:
    """Cached rows in as many partitions as hold about ``each`` bytes of the cache, or as they have if these are fewer.

    For estimators of hundreds of short jobs over the same rows, several at a time: such a job then costs
    a pass over its bytes, not the start of a task for every piece of a file and of a tree of sums above them.
    """
    cached.count()  # fills the cache, whose size Catalyst then knows
    size = int(cached.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return cached.coalesce(max(1, math.ceil(size / each)))


def sweep(train: DataFrame, test: DataFrame, settings: dict[str, object], also_train: bool = False, gather: bool = False) -> DataFrame:
    """Fit each named estimator and report its error on the test (and training) rows."""
    train = train.persist()
    rows, learned = [], gathered(train) if gather else train
    for name, estimator in settings.items():
        model = estimator.fit(learned)
        own = 1.0 - accuracy(model.transform(train)) if also_train else None
        rows.append((name, own, 1.0 - accuracy(model.transform(test))))
    train.unpersist()
    return test.sparkSession.createDataFrame(rows, "setting string, train_error double, test_error double")


def tune_and_refit(train: DataFrame, valid: DataFrame, test: DataFrame, settings: dict[str, object]) -> DataFrame:
    """Errors on training and validation rows for each setting; the best on validation is
    fitted again on both together, and only that model sees the test rows."""
    both = train.unionByName(valid).persist()
    train, rows = train.persist(), []
    for name, estimator in settings.items():
        model = estimator.fit(train)
        rows.append((name, 1.0 - accuracy(model.transform(train)), 1.0 - accuracy(model.transform(valid))))
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    error = 1.0 - accuracy(settings[best].fit(both).transform(test))
    train.unpersist()
    both.unpersist()
    return test.sparkSession.createDataFrame([(*r, error if r[0] == best else None) for r in rows], "setting string, train_error double, valid_error double, test_error double")


def text_points(train: DataFrame, test: DataFrame, tokens: str, label: str, size: int):
    """TF-IDF vectors over the ``size`` most frequent training words: (training rows, test rows, words, classes)."""
    counter = CountVectorizer(inputCol=tokens, outputCol="counts", vocabSize=size).fit(train)
    weigh = IDF(inputCol="counts", outputCol="features").fit(counter.transform(train))
    classes = few_values(train, label)
    index = F.coalesce(*[F.when(F.col(label) == c, F.lit(float(i))) for i, c in enumerate(classes)])
    a, b = (weigh.transform(counter.transform(d)).select("features", index.alias("label")).dropna() for d in (train, test))
    return a, b, len(counter.vocabulary), len(classes)


def dealt_for_dense(train: DataFrame, size: int, each: int = 128 << 20) -> DataFrame:
    """Rows for an estimator that stacks sparse vectors as dense ones and keeps them: partitions hold about ``each`` bytes of these."""
    parts = math.ceil(train.count() * size * 8 / each)
    return train.repartition(max(parts, train.rdd.getNumPartitions())) if parts > 1 else train


def gaussian_nb() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def logistic_regression_grid(train: DataFrame, regs: list[float], folds: int = 3, seed: int = 7) -> DataFrame:
    """Cross-validated accuracy for L1 and L2 penalties; all best settings are marked."""
    train = train.persist()
    lr = LogisticRegression()
    grid = ParamGridBuilder().addGrid(lr.regParam, regs).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
                        numFolds=folds, seed=seed, parallelism=4).fit(train)
    train.unpersist()
    best = max(cv.avgMetrics)
    rows = [(float(p[lr.regParam]), "l1" if p[lr.elasticNetParam] else "l2", float(m), bool(m == best)) for p, m in zip(grid, cv.avgMetrics)]
    return train.sparkSession.createDataFrame(rows, "reg double, penalty string, accuracy double, is_best boolean")


def linear_svm(reg: float = 0.01, iterations: int = 100) -> OneVsRest:
    """One class against the rest; up to 16 classes are fitted at a time, as one fit alone is a chain of short jobs."""
    return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=iterations, tol=1e-3), parallelism=16)


def linear_perceptron(size: int, classes: int, seed: int = 7) -> MultilayerPerceptronClassifier:
    """No hidden layer: one weight vector per class."""
    return MultilayerPerceptronClassifier(layers=[size, classes], maxIter=100, seed=seed)


def decision_tree(impurity: str, least: int) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(impurity=impurity, minInstancesPerNode=least, maxDepth=6, seed=7)


def random_forest(depth: int, trees: int = 100) -> RandomForestClassifier:
    return RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=7)


def extra_trees(depth: int, trees: int = 100) -> ExtraTrees:
    """Cut points drawn at random between the extremes of a node, one for each of a few random features."""
    return ExtraTrees(depth, trees)


def gradient_boosting(depth: int, rounds: int, step: float) -> GBTClassifier:
    return GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=step, seed=7)


def learning_curve(train: DataFrame, test: DataFrame, order: str, sizes: list[int], estimator) -> DataFrame:
    """Accuracy when only the first n training rows are used."""
    rows = [(n, accuracy(estimator.fit(train.orderBy(order).limit(n)).transform(test))) for n in sizes]
    return train.sparkSession.createDataFrame(rows, "n bigint, accuracy double")


def per_cluster_fit(train: DataFrame, valid: DataFrame, cluster: str, estimators: dict[str, object]):
    """One model per cluster and algorithm with its validation accuracy.

    Clusters are few; each fit is a distributed job on its own slice.
    """
    train, valid = train.persist(), valid.persist()
    clusters = few_values(train, cluster)
    models, rows = {}, []
    for c in clusters:
        here = F.col(cluster).eqNullSafe(F.lit(c))
        own, check = train.filter(here), valid.filter(here)
        size = check.count()
        for name, estimator in estimators.items():
            model = estimator.fit(own)
            models[c, name] = model
            rows.append((c, size, name, accuracy(model.transform(check)) if size else 0.0))
    table = train.sparkSession.createDataFrame(rows, f"{cluster} int, size bigint, model string, score double")
    train.unpersist()
    valid.unpersist()
    return models, table


def ensemble_predict(df: DataFrame, cluster: str, models: dict, best: DataFrame) -> DataFrame:
    """Each cluster predicted by its best model; the parts are put together again.

    Rows of a cluster without one (never met in training, or no score above 0) are predicted 0.
    """
    parts, left = [], F.lit(True)
    for r in best.collect():  # one row per cluster
        here = F.col(cluster).eqNullSafe(F.lit(r[cluster]))
        scored = models[r[cluster], r["model"]].transform(df.filter(here))
        parts.append(scored.select(*df.columns, "prediction"))
        left = left & ~here
    out = df.filter(left).select(*df.columns, F.lit(0.0).alias("prediction"))
    for p in parts:
        out = out.unionByName(p)
    return out


def persist_model(model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

