import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import classifier
from sparkloom.llm.queries import QUERIES


def test_pool_adjacent_is_isotonic_regression():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 9)
        y, w = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n).astype(float)
        got = classifier.pool_adjacent(y, w)
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) if a <= i else -1 for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_kernel_is_approximated(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(rng.standard_normal(classifier.STATS).tolist(), int(i % 2), int(i % 3 > 0)) for i in range(60)], "x array<double>, y int, half int")
    m = classifier.fit(df, feature_count=4096)
    x = rng.standard_normal((6, classifier.STATS)) * m.spread + m.mean
    z = m.map(x)[:, :-1]
    s = (x - m.mean) / m.spread
    want = np.exp(-((s[:, None] - s[None]) ** 2).sum(axis=2) / (2 * classifier.STATS))
    assert np.abs(z @ z.T - want).max() < 0.08
    sums = classifier._normal_equations(df, m).sum(axis=0)  # partition sums are the normal equations
    rows = df.collect()
    full, y = m.map(np.array([r.x for r in rows])), np.array([float(r.y) for r in rows])
    assert np.allclose(sums, full.T @ np.column_stack([full, y]))


def junk(rnd, n):
    return " ".join(rnd.choice(["AAA!!", "BBB##", "CCC%%"]) for _ in range(n))


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinsh") for _ in range(rnd.randint(2, 8))) for _ in range(n)) + "."


def test_learns_and_handles_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, (junk if i % 2 else prose)(rnd, rnd.randint(5, 200))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, prose(rnd, 60_000)), (None, prose(rnd, 50)), rows[0], rows[1]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] + [(3, None), (None, 1), (9999, 0), (0, 1), (5, 7)], "doc_id long, quality int")
    got = [(r.doc_id, r.score) for r in classifier.score(docs, labels, usable=F.col("doc_id") % 5 != 0).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert all((by[i] >= 0.5) == (i % 2 == 0) for i in range(120, 200)) and by[502] > 0.5 and by[None] > 0.5


def test_no_labels_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(r.score - 0.5) < 0.02 for r in classifier.score(docs, none).collect())
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in classifier.score(docs, one).collect())
    assert classifier.score(docs.limit(0), one).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op10_quality_classifier"](spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    n, right = got.join(labels, "doc_id").agg(F.count("*"), F.count_if(F.col("quality") == F.col("predicted"))).first()
    assert n > 80 and right / n > 0.95
