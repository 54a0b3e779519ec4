"""The approximate neighbour search: recall, cost, copies, dense groups, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import approximate


def table(spark, x, first=0):
    return spark.createDataFrame(pa.table({"id": np.arange(first, first + len(x)), "v": [r.tolist() for r in x]})).repartition(8)


def recall(x, asked, k, found):
    got = {}
    for r in found:
        got.setdefault(r.qid, set()).add(r.cid)
    hit = 0
    for i in asked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += len(got.get(int(i), set()) & set(np.argsort(d, kind="stable")[:k].tolist()))
    return hit / (k * len(asked))


def groups(rng, n, size=64, centres=300):
    return rng.standard_normal((centres, size))[rng.integers(0, centres, n)] + 0.35 * rng.standard_normal((n, size))


@pytest.mark.parametrize("kind", ["groups", "a third in one dense group"])
def test_recall_on_twenty_thousand_vectors(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "groups":
        x = groups(rng, 20_000)
    else:
        x = np.vstack([groups(rng, 13_500), rng.standard_normal(64) + 1e-3 * rng.standard_normal((6500, 64))])
    df = table(spark, x).persist()
    asked = df.where("id % 50 = 0")
    found = approximate.approximate_join(asked, df, "id", "v", 10, include_self=False).collect()
    assert recall(x, np.arange(0, 20_000, 50), 10, found) >= 0.9
    compared = approximate.approximate_join(asked, df, "id", "v", 10, include_self=False, counted=True).first()[0]
    assert compared < 0.35 * 400 * 20_000
    df.unpersist()


def test_cost_grows_with_the_rows_not_their_square(spark):
    rng = np.random.default_rng(2)
    share = []
    for n in (5000, 40_000):
        df = table(spark, groups(rng, n, 16, 1000)).persist()
        asked = df.where(f"id % {n // 200} = 0")
        share.append(approximate.approximate_join(asked, df, "id", "v", 5, counted=True).first()[0] / asked.count())
        df.unpersist()
    assert share[1] < 4 * share[0]  # eight times the rows


def test_distances_ranks_and_reruns(spark):
    rng = np.random.default_rng(3)
    x = groups(rng, 3000, 12, 40)
    df = table(spark, x)
    first = sorted(map(tuple, approximate.approximate_join(df.where("id < 60"), df, "id", "v", 4).collect()))
    assert first == sorted(map(tuple, approximate.approximate_join(df.where("id < 60").repartition(3), df.repartition(5), "id", "v", 4).collect()))
    for q, c, d, _ in first:
        assert abs(d - np.linalg.norm(x[q] - x[c])) < 1e-9
    by = {}
    for q, c, d, r in first:
        by.setdefault(q, []).append((d, c, r))
    assert all([r for *_, r in sorted(v)] == [1, 2, 3, 4] for v in by.values())
    assert all(sorted(v)[0][1] == q for q, v in by.items())  # itself


def test_copies_nulls_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(2000)] + [(5000, [1.0, 2.5]), (5001, [9.0, 9.0]), (None, [1.0, 2.0]), (6000, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>").withColumns({"node": F.lit("x"), "rank": F.lit(1)})
    got = approximate.approximate_join(df.where("id in (7, 5000, 6000)"), df, "id", "v", 3, include_self=False).orderBy("qid", "rank").collect()
    assert [(r.qid, r.cid) for r in got] == [(7, 0), (7, 1), (7, 2), (5000, 0), (5000, 1), (5000, 2)]
    assert approximate.approximate_join(df, df.limit(0), "id", "v", 3).count() == 0
    assert approximate.approximate_join(df.limit(0), df, "id", "v", 3).count() == 0
    one = approximate.approximate_join(df.where("id = 5001"), df.where("id = 5001"), "id", "v", 3).collect()
    assert [(r.qid, r.cid, r.distance, r["rank"]) for r in one] == [(5001, 5001, 0.0, 1)]


def test_cosine_form(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = approximate.approximate_cosine(df.where("id = 0"), df, "id", "v", 2).orderBy("rank").collect()
    assert [r.cid for r in got] == [1, 2] and abs(got[0].cosine - 2 / np.hypot(2, 0.1)) < 1e-9 and abs(got[1].cosine) < 1e-9


def test_probes_leave_in_bounded_batches():
    rng = np.random.default_rng(9)
    rows, size = 600, 4
    flat = lambda x: pa.array([r.tolist() for r in x], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["0"] * rows), pa.array([0] * rows, pa.int32()), pa.array(np.arange(rows)), flat(rng.standard_normal((rows, size))), flat(np.zeros((rows, size))),
         pa.array(np.ones(rows)), pa.array([10] * rows, pa.int32())], names=["node", "tab", "id", "vec", "centre", "spread", "bits"])
    sent = [len(b) for b in approximate._probe(size, 7, 0, float("inf"))(iter([batch]))]
    assert sum(sent) == rows * 1024 and max(sent) <= 8192
