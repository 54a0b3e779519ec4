"""Extremely randomised trees against a plain version with the same draws."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkloom.operators import models, trees


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id bigint, v array<double>, label double").withColumn("features", array_to_vector("v")).drop("v").repartition(5)


def plain(x, y, est, tree):
    """{node: (feature, point)} and {node: class counts} of one tree, grown by recursion."""
    labels = sorted(set(y))
    count = est.features or math.ceil(math.sqrt(x.shape[1]))
    cuts, counts = {}, {}

    def grow(node, rows, depth):
        own = [sum(1 for r in rows if y[r] == c) for c in labels]
        counts[node] = own
        if depth == est.depth or max(own) == len(rows) or len(rows) < 2 * est.least:
            return
        features, where = trees.draws(est.seed, tree, node, x.shape[1], count)
        best = None
        for f, u in zip(features, where):
            v = x[rows, f]
            point = v.min() + u * (v.max() - v.min())
            left, right = [r for r in rows if x[r, f] <= point], [r for r in rows if x[r, f] > point]
            if min(len(left), len(right)) < est.least:
                continue
            cost = sum(len(s) - sum(sum(1 for r in s if y[r] == c) ** 2 for c in labels) / len(s) for s in (left, right))
            if best is None or cost < best[0]:
                best = cost, int(f), point, left, right
        if best:
            cuts[node] = best[1:3]
            grow(2 * node, best[3], depth + 1)
            grow(2 * node + 1, best[4], depth + 1)

    grow(trees.ROOT, list(range(len(x))), 0)
    return cuts, counts


@pytest.mark.parametrize("least, features", [(1, None), (7, 3)])
def test_equals_plain_trees(spark, least, features):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(250, 9)).round(1)  # with ties
    x[:, 4] = 2.0  # a constant feature
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)
    est = trees.ExtraTrees(depth=6, trees=7, features=features, least=least, seed=3)
    forest = est.fit(frame(spark, x, y))
    for t in range(7):
        cuts, counts = plain(x, y.tolist(), est, t)
        assert {n: c for (k, n), c in forest.cuts.items() if k == t} == cuts
        assert {n: c.tolist() for (k, n), c in forest.counts.items() if k == t} == counts
    share = np.zeros((250, 3))
    for t in range(7):
        cuts, counts = plain(x, y.tolist(), est, t)
        for i in range(250):
            n = trees.ROOT
            while n in cuts:
                n = 2 * n + (x[i, cuts[n][0]] > cuts[n][1])
            share[i] += np.array(counts[n]) / sum(counts[n])
    got = {r.id: r.prediction for r in forest.transform(frame(spark, x, y)).collect()}
    best = share.argmax(axis=1)
    clear = [i for i in range(250) if np.sort(share[i])[-1] - np.sort(share[i])[-2] > 1e-9]
    assert len(clear) > 200 and all(got[i] == best[i] for i in clear)


def test_learns_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = frame(spark, x, y)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    a, b = (trees.ExtraTrees(8, 40).fit(d) for d in (train, train.coalesce(1)))
    assert a.cuts == b.cuts
    assert models.accuracy(a.transform(test)) > 0.8
    nodes = a.nodes(spark)
    assert nodes.where("feature is not null").count() == len(a.cuts) and nodes.where("node = 1").select(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda p, q: p + q))).first()[0] == 40 * 800


def test_rows_that_teach_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [1.0, 2.0], 0.0), (3, None, 1.0), (4, [5.0, 2.0], None), (5, [1.0, 2.0], 0.0)], "id bigint, v array<double>, label double")
    df = df.withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector(F.coalesce("v", F.array()))))
    forest = trees.ExtraTrees(4, 3).fit(df)
    assert not forest.cuts and all(c.tolist() == [2, 1] for c in forest.counts.values())  # equal rows: nothing to cut
    assert forest.transform(df.where("id = 1")).first().prediction == 0.0
    with pytest.raises(ValueError):
        trees.ExtraTrees(2, 2).fit(df.limit(0))
