"""Interval sweeps, products by size, correlations of many series, samples of files."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregate, joins, linalg, select
from sparkloom.runtime import range_ordered, running_totals
from sparkloom.sources import readers, sinks

T0 = dt.datetime(2024, 1, 1)


def hours(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def intervals(spark, rows):
    return spark.createDataFrame([(t, hours(a), hours(b)) for t, a, b in rows], "title string, lo timestamp_ntz, hi timestamp_ntz").repartition(5)


def some(seed, n):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rnd.randrange(0, 3000)
        rows.append((rnd.choice(["hot"] * 8 + ["b", None]), a, a + rnd.choice([0, 1, 2, 3, 5, 24 * 31 if rnd.random() < 0.02 else 1])))
    return rows + [("b", None, 5), ("b", 7, None), ("b", 9, 4), ("hot", 4000, 4001), ("hot", 4001, 4002), ("hot", 4001, 4002)]


def merged(rows):
    out = []
    for t in {r[0] for r in rows}:
        block = None
        for a, b in sorted((a, b) for u, a, b in rows if u == t and a is not None and b is not None and a <= b):
            if block and a <= block[1]:
                block[1] = max(block[1], b)
            else:
                block = [a, b]
                out.append((t, block))
    return sorted(((t, *b) for t, b in out), key=str)


@pytest.mark.parametrize("parts", [1, 8])
def test_merge_equals_brute_force(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for seed in range(3):
            rows = some(seed, 400)
            got = joins.merge_intervals(intervals(spark, rows), ["title"], "lo", "hi")
            as_hours = lambda d: int((d - T0).total_seconds() // 3600)
            assert sorted(((r.title, as_hours(r.lo), as_hours(r.hi)) for r in got.collect()), key=str) == merged(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert joins.merge_intervals(intervals(spark, some(1, 5)).limit(0), ["title"], "lo", "hi").count() == 0


def test_flags_equal_brute_force(spark):
    rows = some(5, 300)
    rnd = random.Random(6)
    pts = [(i, rnd.choice([None, *[rnd.randrange(-5, 4100)] * 30])) for i in range(500)] + [(i, 4001) for i in range(500, 700)] + [(3, 10)]
    points = spark.createDataFrame([(i, hours(h), 1, "x") for i, h in pts], "id bigint, at timestamp_ntz, lo int, _title string").repartition(6)
    got = joins.flag_active_intervals(points, "id", "at", intervals(spark, rows), "title", "lo", "hi", "1 hour", "2 hours", ["hot", "b", "none"])
    assert got.columns == ["id", "at", "lo", "_title", "hot", "b", "none"]
    flag = lambda t, h: int(h is not None and any(u == t and a is not None and b is not None and a <= b + 3 and a - 1 <= h <= b + 2 for u, a, b in rows))
    assert sorted((r.id, str(r.at), r.hot, r.b, r.none) for r in got.collect()) == sorted((i, str(hours(h)), flag("hot", h), flag("b", h), 0) for i, h in pts)


def test_a_title_with_most_intervals_is_many_tasks(spark):
    n = 20_000
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp_ntz")
    many = spark.range(n).select(F.lit("hot").alias("title"), base.alias("lo"), (base + F.expr("interval 31 days")).alias("hi"))
    assert joins._edges(many, ["title"], "lo", "hi").count() == 2 * n  # an interval is two rows however long it is
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = range_ordered(joins._edges(many, ["title"], "lo", "hi"), "title", "_at", "_side").groupBy("_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) == 8 and max(r["count"] for r in parts) < n
    swept = running_totals(joins._edges(many, ["title"], "lo", "hi"), ["title", "_at", "_side"], {"_step": "_open"})
    assert swept.agg(F.max("_open")).first()[0] == 31 * 144 + 1
    assert joins.merge_intervals(many, ["title"], "lo", "hi").count() == 1


def test_running_totals_of_several_columns(spark):
    rows = [(i, i % 3, -(i % 5)) for i in range(500)]
    got = running_totals(spark.createDataFrame(rows, "k int, a int, b int").repartition(7), ["k"], {"a": "ra", "b": "rb"}).orderBy("k").collect()
    a = b = 0
    for (k, x, y), r in zip(rows, got):
        a, b = a + x, b + y
        assert (r.k, r.a, r.b, r.ra, r.rb) == (k, x, y, a, b)


@pytest.mark.parametrize("strips", [None, 3])
def test_products(spark, strips):
    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(7).withColumnRenamed("id", "b")
    assert sorted(map(tuple, joins.cartesian(a, b, strips).collect())) == [(i, j) for i in range(30) for j in range(7)]


def test_large_products_are_dealt_into_strips(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = joins.cartesian(spark.range(40).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and got.distinct().count() == 360
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_hundreds_of_series_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 476)) * rng.choice([0.01, 100], 476) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x], "v array<double>").repartition(4)
    got = linalg.pair_moments(df, "v", 476)
    rows = {(r.i, r.j): r for r in got.where("i in (0, 7, 300) or (i = 475 and j = 475)").collect()}
    assert got.count() == 476 * 477 // 2
    for (i, j), r in rows.items():
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        assert r.n == both.sum() and np.isclose(r.cov, np.cov(a, b)[0, 1], rtol=1e-9, atol=1e-12)
        if i == 7 or j == 7:
            assert r.corr is None
        else:
            assert np.isclose(r.corr, np.corrcoef(a, b)[0, 1], rtol=1e-9)


def test_pairwise_with_gaps_and_single_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.5, None), (4.0, None, 1.0)], "a double, b double, c double")
    got = {(r.x, r.y): (r.cov, r.corr) for r in aggregate.pairwise(df, ["a", "b", "c"]).collect()}
    assert np.allclose(got["a", "b"], (1.25, 1.0)) and got["b", "c"] == (None, None) and got["c", "c"] == (None, None)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "AdaptiveSparkPlan" in name:
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if name.startswith("Scan"):
                found.append((p.metrics().apply("numFiles").value(), p.metrics().apply("filesSize").value()))
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_blocks_that_are_not_drawn_are_never_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100_000).withColumn("x", F.rand(1)).repartition(200).write.parquet(path)
    whole = files_read(spark.read.parquet(path).groupBy().agg(F.sum("x")))[0]
    drawn = select.sample_blocks(spark.read.parquet(path), 25)
    n, size = files_read(drawn.groupBy().agg(F.sum("x")))[0]
    assert whole[0] == 200 and 25 <= n <= 75 and abs(size / whole[1] - n / 200) < 0.02
    per_file = lambda df: {r.f: r["count"] for r in df.groupBy(F.col("_metadata.file_name").alias("f")).count().collect()}
    every, some_ = per_file(spark.read.parquet(path)), per_file(drawn)
    assert len(some_) == n and some_ == {f: every[f] for f in some_} == per_file(select.sample_blocks(spark.read.parquet(path), 25))


def test_one_file_per_key(spark, tmp_path):
    path = str(tmp_path / "keys")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c.d", 4)], "key string, n int").repartition(3)
    sinks.write_per_key_files(df, "key", path)
    assert sorted(p.name for p in (tmp_path / "keys").iterdir() if not p.name.startswith(".")) == ["a.csv", "b.csv", "c.d.csv"]
    got = readers.scan_per_key_files(spark, path, "n int", omit=["b"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (3, "a"), (4, "c.d")]
    assert files_read(readers.scan_per_key_files(spark, path, "n int", keep=["b"]))[0][0] == 1
    for odd in ("x/y", "", None):
        with pytest.raises(ValueError):
            sinks.write_per_key_files(spark.createDataFrame([(odd, 1)], "key string, n int"), "key", path)
