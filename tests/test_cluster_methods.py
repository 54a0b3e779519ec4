"""Components, seeded k-means, mixture starts, elastic-net paths."""

import random

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sparkloom.operators import clusters, models


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(4)


def test_a_random_path_takes_few_rounds(spark):
    order = list(range(1000))
    random.Random(1).shuffle(order)
    name = lambda i: f"{i:04d}"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in zip(order, order[1:])], "a string, b string")
    nodes = spark.createDataFrame([(name(i),) for i in [*order, 5000]], "node string")
    rounds = []
    got = clusters.connected_components(edges, nodes, rounds)
    assert {(r.root, r.n) for r in got.groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()} == {("0000", 1000), ("5000", 1)}
    assert len(rounds) <= 12


def planted(seed, n=3000, k=8, size=6):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, size))[np.arange(n) % k] * 6 + rng.normal(size=(n, size))


def cost(x, centres):
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_minibatch_kmeans(spark):
    x = planted(1)
    df = frame(spark, x)
    centres, found = clusters.minibatch_kmeans(df, "id", "v", 8)
    full = KMeans(k=8, seed=7).fit(df.select(array_to_vector("v").alias("features"))).summary.trainingCost
    assert cost(x, centres) <= 1.03 * full
    got = {r.id: r.cluster for r in found.collect()}
    assert [got[i] for i in range(len(x))] == ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    again, _ = clusters.minibatch_kmeans(df.coalesce(1), "id", "v", 8)
    assert np.array_equal(centres, again)
    assert clusters.minibatch_kmeans(df.limit(0), "id", "v", 3)[1].count() == 0


def test_a_step_reads_its_own_batch(spark):
    df = frame(spark, planted(2, 400))
    centres, _ = clusters.minibatch_kmeans(df, "id", "v", 5, batches=4, epochs=1)
    assert centres.shape == (5, 6)
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(None, [0.0, 0.0]), (99, None)], "id bigint, v array<double>")
    centres, found = clusters.minibatch_kmeans(copies, "id", "v", 3)
    assert centres.tolist() == [[1.0, 2.0]] and found.count() == 50


def test_seeds_cover_planted_groups(spark):
    x = planted(3, 2000, 12)
    df = frame(spark, x)
    seeds = clusters.seed_centres(df, 6, 12, 5)
    first = np.array([x[i] for i in range(12)])  # the old kind of start: rows as they come, here one of each group at best
    assert len(seeds) == 12 and cost(x, seeds) < 3 * cost(x, first)
    rows = np.random.default_rng(0).choice(2000, 12, replace=False)
    assert cost(x, seeds) <= cost(x, x[rows])
    assert np.allclose(cost(x, seeds), cost(x, clusters.seed_centres(df.repartition(7), 6, 12, 5)), rtol=0.5)


def test_mixtures_keep_the_likeliest_start(spark):
    x = planted(4, 900, 3, 3)
    df = frame(spark, x)
    got = {r.k: r for r in clusters.mixture_choice(df, "id", "v", 3, [1, 3], ("diagonal",)).collect()}
    points = df.select("v")
    hashed = np.array([r.v for r in df.orderBy(F.xxhash64("id"), "id").limit(3).collect()])
    assert got[3].log_likelihood >= clusters.fit_mixture(points, 3, hashed, "diagonal")[0] - 1e-3 * abs(got[3].log_likelihood)
    assert got[3].bic < got[1].bic


def regression(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 3, 1] + [0, 5, 1, 0, 2]
    x[:, 4] = 2.0  # no variance
    x[:, 3] += 0.8 * x[:, 0]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=n) + 4
    names = list("abcde")
    return x, y, names, spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))


def test_path_is_optimal_and_equals_the_library(spark):
    x, y, names, df = regression(spark)
    for mix in (0.0, 0.5, 1.0):
        path = models.elastic_net_path(models.gram(df, names, "y"), [0.5, 0.001, 0.1], mix)
        points = df.select(array_to_vector(F.array(*names)).alias("features"), F.col("y").alias("label"))
        for alpha, fit in path.items():
            beta = np.array([fit[c] for c in names])
            sd, spread = x.std(axis=0, ddof=1), y.std(ddof=1)
            z = (x - x.mean(axis=0)) / np.where(sd > 1e-9, sd, 1)
            b = beta * sd
            slope = z.T @ (y - y.mean() - z @ b) / len(y) - alpha * (1 - mix) / spread * b
            for j in range(4):
                if b[j]:
                    assert abs(slope[j] - alpha * mix * np.sign(b[j])) < 1e-8
                else:
                    assert abs(slope[j]) <= alpha * mix + 1e-8
            assert beta[4] == 0
            model = LinearRegression(regParam=alpha, elasticNetParam=mix, tol=1e-12, maxIter=1000).fit(points)
            assert np.allclose(beta, model.coefficients.toArray(), atol=2e-3) and abs(fit["intercept"] - model.intercept) < 1e-2


def test_strong_penalties_leave_the_mean(spark):
    _, y, names, df = regression(spark, 2)
    fit = models.elastic_net_path(models.gram(df, names, "y"), [1e6], 0.7)[1e6]
    assert all(fit[c] == 0 for c in names) and abs(fit["intercept"] - y.mean()) < 1e-9
    flat = models.elastic_net_path(models.gram(df.withColumn("y", F.lit(3.0)), names, "y"), [0.1])[0.1]
    assert abs(flat["intercept"] - 3) < 1e-9 and all(flat[c] == 0 for c in names)
