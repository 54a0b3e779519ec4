"""Small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import arrays, geo, textfn, timeparts
from sparkloom.operators import aggregate, clusters, joins, linalg, models, select, sequence, setops, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def words_df(spark, line):
    return spark.createDataFrame([(w,) for w in line.split()], "w string")


def test_array_max_sum(spark):
    df = spark.createDataFrame([([3, 4],), ([2, 1],), ([7, 9],)], "a array<int>")
    assert df.agg(arrays.array_max_sum(F.col("a"))).first()[0] == 15
    assert df.agg(F.max(F.array_max("a"))).first()[0] == 9


def test_positive_cos(spark):
    assert one(spark, arrays.positive_cos(F.col("a")), a=[0, 2, 1]) == [0, 1]


def test_long_words(spark):
    assert one(spark, textfn.long_words(F.split("t", " ")), t="this is the best mac ever") == ["this", "best", "ever"]


def test_explode_range(spark):
    df = spark.createDataFrame([(2,), (3,), (5,), (0,)], "n int")
    assert sorted(r[0] for r in df.select(arrays.explode_range(F.col("n"))).collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 5]


def test_set_operations(spark):
    a = words_df(spark, "spark basics big data analysis spring")
    b = words_df(spark, "spark using pyspark big data")
    assert setops.union_all(a, b).count() == 11
    assert {r.w for r in setops.intersect_distinct(a, b).collect()} == {"data", "big", "spark"}
    assert {r.w for r in setops.subtract_all(a, b, "w").collect()} == {"spring", "analysis", "basics"}
    twice = words_df(spark, "a a b")
    assert [r.w for r in setops.subtract_all(twice, words_df(spark, "b"), "w").collect()] == ["a", "a"]
    # A word twice on one side only is not common.
    assert setops.intersect_distinct(twice, words_df(spark, "b")).count() == 1


def test_except_then_union_is_left_associative(spark):
    a, b, c = (words_df(spark, x) for x in ("x y", "x", "x"))
    assert {r.w for r in setops.except_then_union(a, b, c).collect()} == {"x", "y"}


def test_kmers(spark):
    df = spark.createDataFrame([("you are my sunshine my only sunshine",), ("too short",), ("",)], "t string")
    top = text.top_kmers(df, "t", 3, 10).collect()
    assert [r.kmer for r in top] == ["are my sunshine", "my only sunshine", "my sunshine my", "sunshine my only", "you are my"]
    assert all(r.n == 1 for r in top)


def test_car_makes(spark):
    makes = spark.createDataFrame([("a", 1, "UK"), ("b", 1, "UK"), ("c", 1, "USA"), ("d", 0, "UK"), ("e", 1, "USA"), ("f", 1, "Italy"), ("g", 1, "UK")],
                                  "id string, common int, country string")
    assert [r.country for r in select.groups_over(makes.limit(3), F.lit(True), "country", 1).collect()] == ["UK"]
    top = aggregate.value_counts(makes.filter("common = 1"), "country", 2).collect()
    assert [(r.country, r.n) for r in top] == [("UK", 3), ("USA", 2)]


def test_count_like(spark):
    df = spark.createDataFrame([("Mexico city",), ("Lima",)], "name string")
    assert select.count_like(df, "name", "%city%").first().n == 1


def test_adjacent_equal(spark):
    assert one(spark, sequence.adjacent_equal(F.col("a"), 5), a=[1, 5, 1, 6, 5, 3, 5, 2]) is False
    assert one(spark, sequence.adjacent_equal(F.col("a"), 5), a=[1, 2, 3, 4, 5, 5, 6, 7, 8, 9]) is True
    assert one(spark, sequence.adjacent_equal(F.col("a"), 5), a=[5]) is False


def test_nan_covariance(spark):
    rows = [[1.0, float("nan"), 3.0, 4.0, 5.0], [2.0, 3.0, 4.0, None, 6.0]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    got = {(r.i, r.j): r for r in linalg.outer_sums(df, "v", 5).collect()}
    assert got[0, 0].s == 5.0 and got[0, 0].n == 2
    assert got[0, 1].s == 6.0 and got[0, 1].n == 1
    assert got[1, 3].n == 0
    assert got[-1, 2].s == 7.0


def test_chi_square_shares(spark):
    men, women = [0.438 * 48, 0.417 * 48, 0.146 * 48], [0.164 * 55, 0.709 * 55, 0.127 * 55]
    rows = [("m", i, float(x)) for i, x in enumerate(men)] + [("w", i, float(x)) for i, x in enumerate(women)]
    table = spark.createDataFrame(rows, "sex string, answer int, n double")
    r = linalg.chi_square(table, "sex", "answer", "n").first()
    total = np.array(men) + np.array(women)
    grand = sum(total)
    want = sum((o - t * s / grand) ** 2 / (t * s / grand) for side, s in ((men, sum(men)), (women, sum(women))) for o, t in zip(side, total))
    assert r.statistic == pytest.approx(want) and r.dof == 2


def test_kmeans_centres(spark):
    data = [-0.1, -0.2, 0.1, 0.2, 0, 0.1, -0.1, 0, -0.05, 0.1, 1.05, 1.1, 0.9, 0.8, 0.9, 1, 1.2, 1.1, 1.2, 0.9]
    df = spark.createDataFrame([([float(x)], 0) for x in data], "v array<double>, label int")
    centres = clusters.centres_of(models.as_points(df, "v", "label"), 2)
    assert centres[0][0] == pytest.approx(0.005) and centres[1][0] == pytest.approx(1.015)


def test_p_values(spark):
    # ten degrees of freedom: the table gives p = 0.07338803 at t = 2
    x = np.array([-1.0, 1.0] * 5 + [0.0])
    shift = 2.0 * x.std(ddof=1) / math.sqrt(11)
    df = spark.createDataFrame([(i, float(v + shift), 0.0) for i, v in enumerate(x)], "k int, a double, b double")
    t, p = linalg.t_test_paired_p(df, "k", "a", "b")
    assert t == pytest.approx(2.0) and p == pytest.approx(0.07338803, rel=1e-6)
    two = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate([3.0, 4.5, 2.0, 6.0, 4.0, 5.5, 3.5])], "v double, g int")
    t, p = linalg.t_test_independent_p(two, "v", F.col("g") == 1)
    assert t == pytest.approx(linalg.t_test_independent(two, "v", F.col("g") == 1).first().t) and 0 < p < 0.05
    rows = spark.createDataFrame([(a, b) for a, b, n in (("m", 0, 8), ("m", 1, 3), ("m", 2, 4), ("w", 0, 2), ("w", 1, 9), ("w", 2, 5)) for _ in range(n)], "sex string, answer int")
    statistic, dof, p = linalg.chi_square_p(rows, "sex", "answer")
    counts = rows.groupBy("sex", "answer").agg(F.count("*").alias("n"))
    assert statistic == pytest.approx(linalg.chi_square(counts, "sex", "answer", "n").first().statistic)
    assert dof == 2 and p == pytest.approx(math.exp(-statistic / 2))  # exact for two degrees of freedom


def test_tokenizer(spark):
    # The alternative for dashed words knows ASCII letters only and comes first, so "café" is cut.
    s = "RT @Bob_1: see http://t.co/AbC :D #Big-Data &amp; caf&eacute; &#65; 3.5 don't ... <b>"
    got = one(spark, textfn.tokenize_social(F.col("t")), t=s)
    assert got == ["rt", "@bob_1", ":", "see", "http://t.co/AbC", ":d", "#big-data", "and", "caf", "é", "a", "3.5", "don't", "...", "<b>"]


def test_text_of_nothing(spark):
    df = spark.createDataFrame([("",), ("...",)], "t string")
    cut = df.select("t", textfn.shape_tokens(F.col("t")).alias("k"), textfn.sentences(F.col("t")).alias("s"))
    rows = cut.select(*[c.alias(n) for n, c in textfn.text_shape(F.col("t"), F.col("k"), F.col("s")).items()]).collect()
    assert rows[0].n_words == 0 and rows[0].punctuation_share == 0.0 and rows[1].punctuation_share == 1.0


def test_direction_quadrants(spark):
    def direction(dlat, dlon):
        return one(spark, geo.segment_direction(F.lit(0.0), F.lit(0.0), F.lit(float(dlat)), F.lit(float(dlon))), a=1)

    assert [direction(1, 0), direction(0, 1), direction(-1, 0), direction(0, -1)] == [1, 2, 3, 4]
    assert direction(1, -0.1) == 1 and direction(0, 0) is None


def test_linestring(spark):
    pairs = one(spark, F.size(geo.consecutive_pairs(geo.parse_linestring(F.col("w")))), w="LINESTRING (-117.1 32.1, -117.2 32.2, -117.3 32.3)")
    assert pairs == 2
    assert one(spark, geo.parse_linestring(F.col("w")), w="POINT (1 2)") is None


def test_clock_and_bucket(spark):
    df = spark.createDataFrame([("2024-01-01 00:05:59.5",), ("2024-01-01 12:44:00",), ("2024-01-01 23:59:00",)], "s string").select(
        F.col("s").cast("timestamp_ntz").alias("t"))
    rows = df.select(timeparts.clock_label(F.col("t")), timeparts.time_bucket(F.col("t"), 15).cast("string")).collect()
    assert [r[0] for r in rows] == ["12:05 a.m.", "12:44 p.m.", "11:59 p.m."]
    assert [r[1] for r in rows] == ["2024-01-01 00:00:00", "2024-01-01 12:30:00", "2024-01-01 23:45:00"]


def test_rush_hour_borders_once(spark):
    df = spark.createDataFrame([("2024-01-03 09:00:00",), ("2024-01-03 09:00:59",), ("2024-01-03 09:30:00",)], "s string").select(
        timeparts.time_bucket(F.col("s").cast("timestamp_ntz"), 30).alias("b"))
    flags = df.distinct().select("b", timeparts.calendar_flags(F.col("b"), [])["is_rushhour"].alias("r")).orderBy("b").collect()
    assert [r.r for r in flags] == [True, False]


def test_points_on_interval_edges(spark):
    pts = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 09:00:00'), (2, timestamp_ntz'2024-01-01 08:59:59'), "
                    "(3, timestamp_ntz'2024-01-02 13:00:00'), (4, timestamp_ntz'2024-01-02 13:00:01') AS v(id, ts)")
    ev = spark.sql("SELECT 'a' AS title, timestamp_ntz'2024-01-01 10:00:00' AS s, timestamp_ntz'2024-01-02 12:00:00' AS e")
    got = joins.flag_active_intervals(pts, "id", "ts", ev, "title", "s", "e", "1 hour", "1 hour", ["a"])
    assert {r.id: r.a for r in got.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_two_digit_years(spark):
    got = one(spark, timeparts.parse_date(F.col("d"), "MM/dd/yy").cast("string"), d="02/29/96")
    assert got == "1996-02-29 00:00:00"
    assert one(spark, timeparts.parse_date(F.col("d"), "MM/dd/yy").cast("string"), d="1/x") is None


def test_latlon(spark):
    lat, lon = geo.parse_latlon(F.col("p"))
    assert one(spark, F.struct(lat, lon), p="32.7 N, 117.1 W")[:] == (32.7, -117.1)


def test_pack_roundtrip(spark):
    df = spark.createDataFrame([([1.5, -2.0],)], "v array<double>")
    assert df.select(arrays.pack_array("v").alias("b")).select(arrays.unpack_array("b")).first()[0] == [1.5, -2.0]


def test_ratios_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert df.agg(aggregate.neg_pos_ratio(F.col("y"))).first()[0] == 99999.0
