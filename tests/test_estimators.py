"""Sweeps over library estimators: their tables against known optima, trees walked one by one and planted data."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkloom.operators import aggregate, clusters, evaluate, models, select


def vectors(spark, x, y, **more):
    names = list(more)
    rows = [(i, [float(v) for v in r], int(c), *extra) for i, (r, c, *extra) in enumerate(zip(x, y, *more.values()))]
    # Not dealt anew: the samples of seeded trees go by the order of rows in their partitions.
    return spark.createDataFrame(rows, ", ".join(["id bigint, v array<double>, label bigint", *[f"{n} int" for n in names]]))


def points(spark, x, y, **more):
    return vectors(spark, x, y, **more).select("id", array_to_vector("v").alias("features"), F.col("label").cast("double"), *more)


def predicted(model, df, n):
    found = dict(model.transform(df).select("id", "prediction").toPandas().itertuples(index=False))
    return np.array([found[i] for i in range(n)])


def squares(seed, n=600):
    """Two classes that no single cut tells apart."""
    x = np.random.default_rng(seed).uniform(-1, 1, size=(n, 3))
    return x, ((x[:, 0] > 0.2) != (x[:, 1] > -0.1)).astype(int)


def overlapping(seed, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x @ [1.5, -1.0, 0.3] + rng.normal(size=n) > 0.4).astype(int)
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), y


def test_gaussian_errors_equal_numpy(spark):
    rng = np.random.default_rng(1)
    y = np.arange(600) % 3
    x = rng.normal(size=(600, 3)) * [[1, 1, 1], [2, 0.5, 1], [1, 1, 3]][0] + y[:, None] * [0.8, -0.5, 0.2]
    x[y == 1] *= [2, 0.5, 1]
    own, other = slice(0, 400), slice(400, 600)
    got = models.tune_gaussian(vectors(spark, x[own], y[own]), vectors(spark, x[other], y[other]), "v", "label", 3, [0.01, 1.0, 100.0]).collect()
    assert [r.c for r in got] == [0.01, 1.0, 100.0]
    for r in got:
        score = np.empty((200, 3))
        for k in range(3):
            rows = x[own][y[own] == k]
            cov = np.cov(rows.T, ddof=0) + r.c * np.eye(3)
            d = x[other] - rows.mean(axis=0)
            score[:, k] = np.log(len(rows) / 400) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1)
        assert r.error == pytest.approx(np.mean(score.argmax(axis=1) != y[other]), abs=1e-12)


def test_logistic_grid(spark):
    x, y = overlapping(2, 900)
    got = {(r.reg, r.penalty): r for r in models.logistic_regression_grid(points(spark, x, y), [0.001, 1000.0]).collect()}
    assert set(got) == {(0.001, "l1"), (0.001, "l2"), (1000.0, "l1"), (1000.0, "l2")}
    best = max(r.accuracy for r in got.values())
    assert [r.is_best for r in got.values()] == [r.accuracy == best for r in got.values()]
    majority = max(y.mean(), 1 - y.mean())
    assert abs(got[1000.0, "l1"].accuracy - majority) < 0.01  # no coefficient is left
    limit = LogisticRegression().fit(points(spark, x, y)).summary.accuracy
    assert best > majority + 0.1 and abs(best - limit) < 0.03


def test_linear_svm_is_at_its_optimum(spark):
    x, y = overlapping(3)
    sign = 2.0 * y - 1
    for reg in (0.01, 0.1):
        one = models.linear_svm(reg).fit(points(spark, x, y)).models[1]  # class 1 against the rest
        w, b = one.coefficients.toArray(), one.intercept
        cost = lambda w, b: np.maximum(0, 1 - sign * (x @ w + b)).mean() + reg / 2 * w @ w  # noqa: B023,E731
        rng = np.random.default_rng(4)
        others = [cost(w + rng.normal(size=3) * s, b + rng.normal() * s) for s in (0.01, 0.05, 0.2, 0.5) for _ in range(200)]
        assert cost(w, b) <= 1.01 * min(others)  # convex: a lowest place nearby is the lowest


def test_linear_perceptron_equals_logistic_regression(spark):
    x, y = overlapping(5)
    y = np.where(x[:, 2] > 1, 2, y)
    df = points(spark, x, y)
    a = predicted(models.linear_perceptron(3, 3).fit(df), df, len(x))
    b = predicted(LogisticRegression(family="multinomial").fit(df), df, len(x))
    assert np.mean(a == b) >= 0.97
    assert abs(np.mean(a == y) - np.mean(b == y)) <= 0.02


def test_sweep_counts_the_errors_of_its_predictions(spark):
    x, y = squares(6, 800)
    train, test = points(spark, x[:500], y[:500]), points(spark, x[500:], y[500:])
    settings = {f"depth={d}": models.random_forest(d, 20) for d in (1, 5)}
    got = {r.setting: r for r in models.sweep(train, test, settings, True).collect()}
    for name, estimator in settings.items():
        model = estimator.fit(train)
        assert got[name].train_error == pytest.approx(np.mean(predicted(model, train, 500) != y[:500]), abs=1e-12)
        assert got[name].test_error == pytest.approx(np.mean(predicted(model, test, 300) != y[500:]), abs=1e-12)
    assert got["depth=5"].test_error < 0.1 < 0.2 < got["depth=1"].test_error
    assert models.sweep(train, test, settings).first().train_error is None


def test_forest_is_the_mean_of_its_trees(spark):
    x, y = squares(7)
    df = points(spark, x, y)
    model = models.random_forest(4, 9).fit(df)
    assert len(model.trees) == 9 and max(t.depth for t in model.trees) <= 4
    found = predicted(model, df, len(x))
    for i in range(25):
        votes = sum(t.predictProbability(Vectors.dense(x[i])).toArray() for t in model.trees)
        assert found[i] == votes.argmax()


def test_boosting_adds_up_its_trees(spark):
    x, y = squares(8)
    df = points(spark, x, y)
    model = models.gradient_boosting(2, 12, 0.3).fit(df)
    assert model.treeWeights == [1.0] + [0.3] * 11 and max(t.depth for t in model.trees) <= 2
    found = predicted(model, df, len(x))
    for i in range(25):
        total = sum(w * t.predict(Vectors.dense(x[i])) for w, t in zip(model.treeWeights, model.trees))
        assert found[i] == (total > 0)
    short = predicted(models.gradient_boosting(2, 1, 0.3).fit(df), df, len(x))
    assert np.mean(found != y) <= np.mean(short != y) and np.mean(found != y) < 0.1


def test_bisecting_cuts_are_nested(spark):
    rng = np.random.default_rng(9)
    group = np.arange(400) % 4
    x = np.array([[0, 0], [0, 4], [40, 0], [40, 4]])[group] + rng.normal(size=(400, 2)) * 0.3
    df = vectors(spark, x, group)
    four, two = ({r.id: r.cluster for r in clusters.cluster_by("Ward", df, "id", "v", k).collect()} for k in (4, 2))
    assert len({(four[i], group[i]) for i in range(400)}) == 4  # the planted groups
    assert len({(two[i], group[i] // 2) for i in range(400)}) == 2  # the widest gap is cut first
    assert len({(four[i], two[i]) for i in range(400)}) == 4


def per_cluster(spark):
    """Cluster 0 suits Gaussians, cluster 1 a tree; cluster 2 is met in the rows to predict only."""
    rng = np.random.default_rng(10)
    x, y = squares(10, 1200)
    cluster = np.arange(1200) % 2
    easy = cluster == 0
    y[easy] = np.arange(1200)[easy] // 2 % 2
    x[easy] = rng.normal(size=(easy.sum(), 3)) + 1.2 * y[easy][:, None]
    cluster[1150:] = 2
    own, other = slice(0, 800), slice(800, 1200)
    return [points(spark, x[s], y[s], cluster=cluster[s].tolist()) for s in (own, other)], y[other], cluster[other]


def test_models_of_clusters(spark):
    (train, test), y, cluster = per_cluster(spark)
    fitted, table = models.per_cluster_fit(train, test, "cluster", {"gaussian": models.gaussian_nb(), "tree": models.decision_tree("gini", 5)})
    rows = {(r.cluster, r.model): r for r in table.collect()}
    assert set(rows) == {(c, m) for c in (0, 1) for m in ("gaussian", "tree")} == set(fitted)
    for (c, m), r in rows.items():
        guess = predicted(fitted[c, m], test, len(y))
        assert r.size == (cluster == c).sum() and r.score == pytest.approx(np.mean(guess[cluster == c] == y[cluster == c]), abs=1e-12)
    best = evaluate.best_model_per_cluster(table, "cluster")
    chosen = {r.cluster: r.model for r in best.collect()}
    assert chosen[1] == "tree"
    out = models.ensemble_predict(test, "cluster", fitted, best)
    got = {r.id: r.prediction for r in out.collect()}
    assert out.count() == len(got) == len(y) and out.columns == [*test.columns, "prediction"]
    want = np.zeros(len(y))  # a cluster without a model is predicted 0
    for c, m in chosen.items():
        want[cluster == c] = predicted(fitted[c, m], test, len(y))[cluster == c]
    assert [got[i] for i in range(len(y))] == want.tolist()


def test_ensemble_without_any_model(spark):
    (_, test), y, _ = per_cluster(spark)
    test = test.withColumn("cluster", F.when(F.col("cluster") < 2, F.col("cluster")))
    nothing = spark.createDataFrame([], "cluster int, model string, score double")
    out = models.ensemble_predict(test, "cluster", {}, nothing)
    assert out.count() == len(y) and {r.prediction for r in out.collect()} == {0.0}


def test_discriminant_equals_numpy(spark):
    rng = np.random.default_rng(11)
    y = np.arange(500) % 3
    x = rng.normal(size=(500, 3)) @ [[1, 0.5, 0], [0, 1, 0], [0, 0.2, 2]] + y[:, None] * [0.7, -0.4, 0.5]
    df = vectors(spark, x, y)
    got = {r.id: r.predicted for r in models.lda_classifier(df, df, "v", "label", 3).collect()}
    means = np.array([x[y == k].mean(axis=0) for k in range(3)])
    pooled = (x - means[y]).T @ (x - means[y]) / 500
    d = x[:, None] - means
    score = np.log(np.bincount(y) / 500) - 0.5 * np.einsum("nki,ij,nkj->nk", d, np.linalg.inv(pooled), d)
    assert np.mean([got[i] == c for i, c in enumerate(score.argmax(axis=1))]) > 0.995


def test_approximate_counts(spark):
    df = spark.range(60_000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") < 0, 1).alias("c"))
    r = aggregate.approximate_distinct(df, "a", "b", "c").first()
    assert abs(r.n_a / 60_000 - 1) < 0.06 and (r.n_b, r.n_c) == (7, 0)  # three deviations; few values are exact


def test_samples_of_rows(spark):
    df = spark.range(0, 50_000, 1, 8)
    one, again, other = ({r.id for r in select.sample_rows(df, 20, seed=s).collect()} for s in (11, 11, 12))
    assert one == again != other
    assert abs(len(one) - 10_000) < 4 * np.sqrt(50_000 * 0.2 * 0.8)
    assert abs(len(one & other) - 2000) < 4 * np.sqrt(2000)  # independent draws


def test_gathered_rows_are_whole_and_in_few_partitions(spark):
    x, y = overlapping(9, 900)
    df = points(spark, x, y).repartition(30).persist()
    size = lambda each: models.gathered(df, each).rdd.getNumPartitions()
    assert size(1 << 20) == 1 and 1 < size(8000) < 30 and size(1) == 30  # by bytes, never more than there were
    assert sorted(map(str, models.gathered(df, 8000).collect())) == sorted(map(str, df.collect()))
    df.unpersist()


def test_linear_svms_are_not_fitted_on_pieces_of_files(spark, tmp_path, monkeypatch):
    """40 small files are one partition of each of the hundreds of passes, with the errors of fits on all pieces."""
    from sparkloom.plans import learning
    from sparkloom.plans.registry import Tables

    rng = np.random.default_rng(11)
    y = np.arange(400) % 3
    x = rng.normal(size=(3, 64))[y] + rng.normal(size=(400, 64))
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "vec_id bigint, embedding array<float>, label int")
    df.repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, plain = [], models.linear_svm

    class Watched:
        def __init__(self, reg):
            self.svm = plain(reg, 10)

        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return self.svm.fit(rows)

    monkeypatch.setattr(models, "linear_svm", Watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        tables = Tables(spark, str(tmp_path))
        got = {r.setting: r.test_error for r in learning.linear_svm_strength(tables).collect()}
        train, test = learning.points(tables)
        pieces = train.rdd.getNumPartitions()
        want = {r.setting: r.test_error for r in models.sweep(train, test, {f"reg={r}": Watched(r) for r in (0.001, 0.01, 0.1)}).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen == [1] * 3 + [pieces] * 3 and pieces > 8
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.05 for k in got)
