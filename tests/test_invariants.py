"""Operators against brute force and against properties they must have."""

import math
import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from sparkloom.operators import aggregate, clusters, eigen, evaluate, joins, linalg, models, neighbours, reshape, select, sequence, text
from sparkloom.plans import learning, shapes, traffic
from sparkloom.runtime import global_row_number, neighbour_in_order, running_total, scratch_path


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")


def brute(q, c, k, metric):
    d = neighbours.distances(q, c, metric)
    return [[int(j) for j in sorted(range(len(c)), key=lambda j: (d[i, j], j))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_knn_is_exact_on_skewed_data(spark, metric):
    rng = np.random.default_rng(1)
    hot = np.repeat(rng.normal(size=(1, 4)), 120, axis=0)  # a third of all rows are copies
    corpus = np.vstack([hot, rng.normal(size=(240, 4))])
    queries = np.vstack([corpus[:3], rng.normal(size=(40, 4))])
    got = neighbours.knn_join(vectors(spark, queries), vectors(spark, corpus), "id", "v", 5, metric, pivots=6, block=25)
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.cid)
    assert [found[i] for i in range(len(queries))] == brute(queries, corpus, 5, metric)


def test_knn_with_fewer_rows_than_k(spark):
    got = neighbours.knn_join(vectors(spark, [[0.0, 0.0]]), vectors(spark, [[1.0, 0.0], [0.5, 0.0]]), "id", "v", 5)
    assert [r.cid for r in got.orderBy("rank").collect()] == [1, 0]


def scratch_bytes(spark):
    folder = pathlib.Path(scratch_path(spark, "size").removeprefix("file:")).parent
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_knn_writes_a_vector_a_few_times_however_many_cells_it_visits(spark, metric):
    x = np.random.default_rng(11).normal(size=(3000, 64))
    x[100:140] = x[100]
    df = vectors(spark, x)
    before = scratch_bytes(spark)
    got = neighbours.knn_join(df, df.where("id >= 0"), "id", "v", 4, metric).where("qid < 150")
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.cid)
    assert [found[i] for i in range(150)] == brute(x[:150], x, 4, metric)
    assert scratch_bytes(spark) - before < 8 * x.nbytes


def test_knn_far_values_and_many_copies(spark):
    x = np.random.default_rng(12).normal(size=(700, 6)) * 10.0 ** np.random.default_rng(13).integers(-3, 18, size=(700, 1))
    x[200:500] = x[7]
    for metric in neighbours.METRICS:
        df = vectors(spark, x)
        found = {}
        for r in neighbours.knn_join(df, df, "id", "v", 3, metric, block=60).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.cid)
        assert [found[i] for i in range(len(x))] == brute(x, x, 3, metric)


def boxes_brute(values, n, strict):
    y0, h = min(values), (max(values) - min(values)) / n
    columns = {}
    for i, v in enumerate(values):
        columns.setdefault(((i + 1) * n - 1) // len(values), []).append(v)
    found = set()
    for c, vs in columns.items():
        found |= {(c, math.floor((v - y0) / h)) for v in vs}
        for b in range(n):
            top = y0 + (b + 1) * h
            if min(vs) <= y0 + b * h and (max(vs) > top if strict else max(vs) >= top):
                found.add((c, b))
    return sum(b < n for _, b in found)


@pytest.mark.parametrize("strict", [True, False])
def test_box_counts_against_brute_force(spark, strict):
    rng = np.random.default_rng(14)
    series = {"a": rng.integers(0, 64, 900), "b": rng.integers(0, 3, 40) * 16, "c": np.arange(65), "flat": np.ones(9)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double").repartition(5)
    plan = linalg.box_counts(df, "k", "i", "v", 32, strict)
    assert {r.k: r.n_boxes for r in plan.collect()} == {k: boxes_brute(x.astype(float).tolist(), 32, strict) for k, x in series.items() if k != "flat"}
    # a union whose parts are coalesced each for itself cannot be grouped: the plan has none
    assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()


def dbscan_brute(x, eps, least):
    d = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        todo.append(j)
    for i in np.flatnonzero(~core):
        near = label[np.flatnonzero(d[i] & core)]
        label[i] = near.min() if len(near) else -1
    return label


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([np.repeat([[0.0, 0.0]], 60, axis=0), rng.normal(0, 0.1, (30, 2)), rng.normal(2, 0.2, (50, 2)), rng.uniform(-3, 5, (60, 2))])
    got = {r.id: r.cluster for r in clusters.dbscan(vectors(spark, x), "id", "v", 2, 0.3, 5, block=13).collect()}
    assert [got[i] for i in range(len(x))] == dbscan_brute(x, 0.3, 5).tolist()


def test_components_of_a_chain(spark):
    nodes = spark.range(40).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("node"))
    edges = spark.range(39).filter("id <> 20").select(F.lpad(F.col("id").cast("string"), 3, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 3, "0").alias("b"))
    roots = {r.root for r in clusters.connected_components(edges, nodes).collect()}
    assert roots == {"000", "021"}


def test_running_total_and_row_number(spark):
    rng = np.random.default_rng(5)
    values = rng.permutation(1000)
    df = spark.createDataFrame([(int(v), 1 + int(v) % 3) for v in values], "k int, n int").repartition(7)
    got = running_total(df, ["k"], "n", "run").orderBy("k").collect()
    assert [r.run for r in got] == np.cumsum([1 + k % 3 for k in range(1000)]).tolist()
    assert [r.rn for r in global_row_number(df, ["k"], "rn").orderBy("k").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_across_chunks(spark, forward):
    rows = [("hot", i * 3 if i < 50 else i * 40, i) for i in range(100)] + [("b", 5, 200), (None, 1, 300), (None, 99, 301)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = neighbour_in_order(df, ["k"], ["t"], F.floor(F.col("t") / 10), {"v": "other"}, forward)
    found = {r.v: r.other for r in got.collect()}
    step = 1 if forward else -1
    want = {i: (i + step if 0 <= i + step < 100 else None) for i in range(100)}
    want.update({200: None, 300: 301 if forward else None, 301: None if forward else 300})
    assert found == want


def test_quantiles(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(300, 2.5), rng.normal(size=601)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    shares = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 1.0]
    got = {r.share: r.value for r in sequence.exact_quantiles(df, "x", shares).collect()}
    assert [got[s] for s in shares] == pytest.approx(np.quantile(x, shares).tolist())


def test_cdf_ends_at_one(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,)], "x double")
    assert [(r.value, r.cdf) for r in sequence.empirical_cdf(df, "x").orderBy("value").collect()] == [(1.0, 2 / 3), (2.0, 1.0)]


def test_densify_has_every_combination(tables):
    g = traffic.grid(tables)
    n_seg, n_time = traffic.segments(tables).count(), traffic.buckets(tables).count()
    assert g.count() == n_seg * n_time == g.select("segment_id", "bucket").distinct().count()
    assert g.filter("level = 0").count() > 0


def test_cartesian_has_every_pair(spark):
    a, b = spark.range(300).withColumnRenamed("id", "a"), spark.range(40).withColumnRenamed("id", "b")
    got = joins.cartesian(a, b)
    assert got.columns == ["a", "b"] and got.count() == got.distinct().count() == 12_000
    assert joins.cartesian(a, b.limit(0)).count() == 0


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 4.0), (3, None, 6.0), (None, "a", 8.0)], "k int, g string, x double")
    keyed = sequence.attach_dense_key(df, ["k", "g"], "id").collect()
    assert len(keyed) == 4 and sorted(r.id for r in keyed) == [1, 2, 3, 4]
    assert sorted((r.k, r.g) for r in sequence.label_encode(df, ["k", "g"]).collect()) == [(0, 1), (1, 1), (2, 0), (3, 0)]
    assert sequence.label_encode(df, ["k", "g"]).columns and df.count() == evaluate.stratified_folds(df, "x", "g", 2).count()
    means = {(r.k, r.g): r.mean_x for r in reshape.with_group_means(df, ["g"], ["x"]).collect()}
    assert means == {(1, "a"): 5.0, (2, None): 5.0, (3, None): 5.0, (None, "a"): 5.0}
    effects = linalg.two_way_effects(df, "k", "g", "x").first()
    assert abs(effects.rms_total - math.sqrt(30)) < 1e-9 and effects.rms_minus_row == 0.0
    assert linalg.chi_square(df, "k", "g", "x").first().dof == 3


def test_few_comparisons_in_three_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(6000, 3))
    df = vectors(spark, x)
    compared = neighbours.knn_join(df, df, "id", "v", 5, block=500, counted=True).first().compared
    assert compared < 0.1 * len(x) ** 2


def test_overlap_of_many_entities(spark):
    # 20,000 entities with sparse ids, each on three days of its group of ten
    rows = spark.range(20_000).select((F.col("id") * 1000 + 7).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "id").select(
        "e", (F.floor(F.col("id") / 10) * 3 + F.col("k")).alias("d"), ((F.col("id") + F.col("k")) % 2).cast("int").alias("f"))
    got = linalg.overlap_significance(rows, "e", "d", "f", 3)
    n, least, most, low, high = got.agg(F.count(F.lit(1)), F.min("m"), F.max("m"), F.min("i"), F.max("j")).first()
    assert (n, least, most, low, high) == (2000 * 45, 3, 3, 7, 19_999_007)
    one = got.where("i = 7 and j = 1007").first()
    assert (one.n1, one.n2, one.l) == (1, 2, 0)


def test_overlap_moves_no_pairs(spark):
    """Pairs come out of their block with names and probability: no join or exchange is above it."""
    rows = spark.range(300).select(F.concat(F.lit("e"), "id").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"), (F.col("id") % 2).cast("int").alias("f"))
    got = linalg.overlap_significance(rows.where("d <> id % 4"), "e", "d", "f", 3, 64)
    above = got._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")[0]
    assert "Join" not in above and "Repartition" not in above
    assert got.count() == 300 * 299 // 2 and got.where("i >= j").isEmpty() and got.where("log_p is null").count() == got.where("m < 3").count() > 0


@pytest.mark.parametrize("n, days, width", [(300, 12, 8), (300, 2, 20), (600, 3, 512)])  # several blocks to a strip; counts priced one by one, looked up, by several rows of a block
def test_overlap_of_strips_equals_products(spark, n, days, width):
    rng = np.random.default_rng(days)
    there, flags = rng.random((n, days)) < 0.5, rng.random((n, days)) < 0.5
    there[: n // 3, 0] = False  # blocks that do not have the day
    flags &= there
    rows = [(f"e{e:04}", d, int(flags[e, d])) for e, d in zip(*np.nonzero(there))]
    rows = [(e, int(d), f) for e, d, f in rows] + [(None, 0, 1), ("x", None, 1), ("e0001", None, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        got = linalg.overlap_significance(spark.createDataFrame(rows, "e string, d int, f int"), "e", "d", "f", 2, width).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    p, f = there.astype(int), flags.astype(int)
    m, n1, n2, l = p @ p.T, f @ p.T, p @ f.T, f @ f.T
    i, j = np.nonzero(np.triu(m, 1))
    log_p = linalg.overlap_log_p(*(x[i, j] for x in (m, n1, n2, l)))
    want = {(f"e{a:04}", f"e{b:04}"): (m[a, b], n1[a, b], n2[a, b], l[a, b], v if m[a, b] >= 2 else None) for a, b, v in zip(i.tolist(), j.tolist(), log_p.tolist())}
    assert len(got) == len(want) and {(r.i, r.j): (r.m, r.n1, r.n2, r.l, r.log_p) for r in got} == want


def test_overlap_copies_days_as_bits(spark, monkeypatch):
    """A day of 4,000 entities meets the others as bits, and not as a row per entity and block."""
    def sizes(width, least):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = sum(b.nbytes for b in batches)
            yield pa.RecordBatch.from_pydict({"i": [0], "j": [0], **{c: [size] for c in ("m", "n1", "n2", "l")}, "log_p": [0.0]})

        return run

    monkeypatch.setattr(linalg, "_strip_pairs", sizes)
    rows = spark.range(4000).select(F.col("id").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("d"), (F.col("id") % 2).cast("int").alias("f"))
    moved = linalg.overlap_significance(rows, "e", "d", "f", 3, 64).agg(F.sum("m")).first()[0]
    assert 4000 * 24 // 4 < moved < 4000 * 24 * 4000 // 64  # a byte for each entity, day and block would be more


def test_spectral_order_equals_dense(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(150, 150))
    m = m + m.T
    m[np.abs(m) < 1] = 0
    pairs = spark.createDataFrame([(i * 11, j * 11, float(m[i, j])) for i in range(150) for j in range(i, 150)], "i bigint, j bigint, v double")
    got = eigen.spectral_order(pairs, "v").orderBy("entity").collect()
    values, vecs = np.linalg.eigh(m)
    want = vecs[:, np.abs(values).argmax()]
    want = want * np.sign(want[np.abs(want).argmax()])
    assert np.allclose([r.loading for r in got], want, atol=1e-6)


def test_cumulative_share_reaches_hundred(tables):
    out = sequence.cumulative_pct(traffic.report(tables), "segment_id", "bucket")
    top = out.agg(F.max("cum_entity_pct"), F.max("cum_pos_pct")).first()
    assert top[0] == 100.0 and top[1] == 100.0


def test_pca_matches_numpy(tables):
    v = shapes.gappy_vectors(tables)
    x = np.array([r.vector for r in v.select("vector").collect()], dtype="float64")
    m = ~np.isnan(x)
    z = np.where(m, x, 0.0)
    mean = z.sum(0) / m.sum(0)
    cov = (z.T @ z) / (m.T.astype(float) @ m) - np.outer(mean, mean)
    fit = linalg.fit_components(v, "vector", 64)
    assert np.allclose(fit.mean, mean) and np.allclose(fit.vectors @ fit.vectors.T, np.eye(64), atol=1e-9)
    assert np.allclose(fit.vectors.T @ np.diag(fit.values) @ fit.vectors, cov, atol=1e-9)
    assert (np.diff(fit.values) <= 1e-12).all() and 1 <= fit.keep(0.9) <= 64
    assert np.cumsum(fit.values)[fit.keep(0.9) - 1] / fit.values.sum() >= 0.9


def test_residuals_of_the_full_basis_vanish(tables):
    v = shapes.gappy_vectors(tables).drop("label")
    fit = linalg.fit_components(v, "vector", 64)
    out = linalg.project_residuals(v, "vector", fit.mean, fit.vectors)
    assert out.agg(F.max("res_64")).first()[0] < 1e-12


def test_alternating_effects_never_rise(spark):
    rng = np.random.default_rng(2)
    rows = [(i, j, float(i + 2 * j + rng.normal())) for i in range(12) for j in range(9) if (i + j) % 4]
    rms = [r.rms for r in linalg.alternating_effects(spark.createDataFrame(rows, "r int, c int, x double"), "r", "c", "x", 4).orderBy("round").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(rms, rms[1:])) and rms[0] < 3


def test_class_moments_and_scores(tables):
    rows = tables.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], dtype="float64")
    y = np.array([r.label for r in rows.orderBy("vec_id").collect()])
    m = models.class_moments(rows, "embedding", "label", 64)
    assert np.allclose(m.means[3], x[y == 3].mean(0))
    assert np.allclose(m.covariances()[3], np.cov(x[y == 3].T, bias=True))
    scored = models.gaussian_generative(rows, rows, "embedding", "label", 64, 0.05).orderBy("vec_id").collect()
    want = m.labels[models.gaussian_scorer(m, 0.05)(x).argmax(1)]
    assert [r.predicted for r in scored] == want.tolist()
    assert (want == y).mean() > 0.9


def test_gram_equals_lstsq(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = 1 + x @ [2.0, -1.0, 0.0] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    g = models.gram(df, ["a", "b", "c"], "y")
    fit = g.fit()
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert [fit["intercept"], fit["a"], fit["b"], fit["c"]] == pytest.approx(want.tolist())
    assert g.mse(fit) == pytest.approx(((np.c_[np.ones(200), x] @ want - y) ** 2).mean())
    steps = models.backward_elimination(g, g, spark).orderBy("step").collect()
    assert steps[0].removed == "none" and len(steps) == 1  # nothing can be dropped without a rise on the same rows


def test_naive_bayes_agrees_with_library(tables):
    docs = tables.documents.select("doc_id", "text", "lang")
    train, test = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    own = text.multinomial_nb(text.doc_terms(train, "doc_id", "text", ["lang"]), text.doc_terms(test, "doc_id", "text"), train.select("doc_id", "lang"), "doc_id", "lang")
    from pyspark.ml.feature import StringIndexer

    from sparkloom.functions.textfn import words

    tok = train.select("doc_id", "lang", words(F.col("text")).alias("w")).filter("size(w) > 0")
    cv = CountVectorizer(inputCol="w", outputCol="features", vocabSize=1 << 20).fit(tok)
    index = StringIndexer(inputCol="lang", outputCol="label").fit(tok)
    model = NaiveBayes(modelType="multinomial", smoothing=1.0).fit(index.transform(cv.transform(tok)))
    other = model.transform(cv.transform(test.select("doc_id", "lang", words(F.col("text")).alias("w")).filter("size(w) > 0")))
    names = F.lit(list(index.labels))
    both = own.join(other.select("doc_id", names[F.col("prediction").cast("int")].alias("lib")), "doc_id")
    # Library priors are smoothed too, so single ties may differ.
    assert both.agg(F.avg((F.col("predicted") == F.col("lib")).cast("int"))).first()[0] > 0.97


def test_folds_are_disjoint_and_even(tables):
    out = evaluate.stratified_folds(tables.events.select("event_id", "event_type"), "event_id", "event_type", 4)
    sizes = out.groupBy("event_type", "fold").count().groupBy("event_type").agg((F.max("count") - F.min("count")).alias("gap"))
    assert sizes.agg(F.max("gap")).first()[0] <= 1 and out.count() == tables.events.count()


def test_week_fold_borders(spark):
    df = spark.createDataFrame([("2024-01-21",), ("2024-01-15",), ("2024-01-14",), ("2024-01-08",), ("2024-01-07",), ("2024-01-22",)], "d string")
    got = [r[0] for r in df.select(evaluate.week_folds(F.col("d").cast("date"), "2024-01-22", 2)).collect()]
    assert got == [0, 0, 1, 1, -1, -1]


def test_downsampling(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "id int, y int")
    out = evaluate.downsample_negatives(df, "id", "y", 3)
    assert out.filter("y = 1").count() == 20 and out.filter("y = 0").count() == 60
    assert evaluate.downsample_negatives(df, "id", "y", 9).count() == 200  # the skew does not exceed the ratio


def test_best_model_needs_a_positive_score(spark):
    s = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "b", 0.5), (2, "a", 0.5)], "cluster int, model string, score double")
    assert [(r.cluster, r.model) for r in evaluate.best_model_per_cluster(s, "cluster").collect()] == [(2, "a")]


def test_fallback_reaches_every_branch(spark):
    keys = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, kind string")
    fine = spark.createDataFrame([(1, 10.0)], "k int, v double")
    coarse = spark.createDataFrame([("x", 5.0)], "kind string, v double")
    got = {r.k: r.v for r in joins.lookup_with_fallback(keys, fine, coarse, "k", "kind", "v", 0.0).collect()}
    assert got == {1: 10.0, 2: 5.0, 3: 0.0}


def test_select_chain_order_matters(spark):
    base = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, odd int")
    half = lambda d: d.orderBy("id").limit(int(d.count() / 2))
    odd = lambda d: d.filter("odd = 1")
    a = {r.id for r in select.select_chain(base, "id", [half, odd]).collect()}
    b = {r.id for r in select.select_chain(base, "id", [odd, half]).collect()}
    assert a == {1, 3} and b == {1, 3} or a != b


def test_aggregates_on_empty_and_null_input(spark):
    empty = spark.createDataFrame([], "k int, x double")
    nulls = spark.createDataFrame([(1, None), (2, None)], "k int, x double")
    assert aggregate.level_stats(empty, ["k"], "x").count() == 0
    assert aggregate.profile_numeric(nulls, ["x"]).first().missing == 2
    assert select.above_average(nulls, "x").count() == 0
    assert sequence.exact_quantiles(nulls, "x", [0.5]).count() == 0
    assert reshape.zscore(nulls, ["x"]).filter("x is not null").count() == 0
    assert joins.count_matches(nulls, empty.select(F.col("k").alias("j")), "k", "j", "n").agg(F.sum("n")).first()[0] == 0


def test_overlap_formula(spark):
    rows = [(e, d, int((d * (e + 1)) % 3 == 0)) for e in range(3) for d in range(30) if (d + e) % 5]
    got = linalg.overlap_significance(spark.createDataFrame(rows, "e int, d int, f int"), "e", "d", "f", 10).collect()
    for r in got:
        a, b = ({d: f for e, d, f in rows if e == x} for x in (r.i, r.j))
        days = a.keys() & b.keys()
        n1, n2, l, m = sum(a[d] for d in days), sum(b[d] for d in days), sum(a[d] * b[d] for d in days), len(days)
        g = lambda n: math.lgamma(n + 1)
        want = (-g(l) - g(n1 - l) - g(n2 - l) - g(m - n1 - n2 + l) - g(m) + g(n1) + g(m - n1) + g(n2) + g(m - n2)) / m
        assert (r.m, r.n1, r.n2, r.l) == (m, n1, n2, l) and r.log_p == pytest.approx(want)


@pytest.mark.parametrize("kind, free", [("spherical", 1), ("diagonal", 3), ("full", 6)])
def test_mixture(spark, kind, free):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(6, 0.5, (150, 3))])
    df = spark.createDataFrame([([float(a) for a in v], int(i >= 200)) for i, v in enumerate(x)], "v array<double>, y int").repartition(3)
    like, n, p, *_ = clusters.fit_mixture(df.select("v"), 3, x[:1], kind)
    d = x - x.mean(0)
    cov = {"full": d.T @ d / len(x), "diagonal": np.diag((d * d).mean(0)), "spherical": np.eye(3) * (d * d).mean()}[kind]
    want = -0.5 * len(x) * (3 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1]) - 0.5 * np.einsum("ij,jk,ik->", d, np.linalg.inv(cov), d)
    assert (n, p) == (350, 3 + free) and like == pytest.approx(want, rel=1e-4)
    r = clusters.mixture_of_classes(df, "v", "y", 3, (kind,)).first()
    assert r.accuracy == 1.0 and r.bic < p * math.log(n) - 2 * like


def test_best_setting_is_refitted(spark):
    rows = [([float(i % 2), float(i)], i % 2) for i in range(60)]
    a, b, c = (models.as_points(spark.createDataFrame(rows[i:i + 20], "v array<double>, y int"), "v", "y") for i in (0, 20, 40))
    got = models.tune_and_refit(a, b, c, {"deep": models.decision_tree("gini", 1), "stump": models.decision_tree("gini", 15)}).collect()
    assert {r.setting: r.test_error for r in got} == {"deep": 0.0, "stump": None}


def test_all_reports_teach_the_profile_clusters(tables, monkeypatch):
    """No segment or road type with reports falls back to another profile."""
    seen = {}
    real = clusters.cluster_assign

    def spy(model, entities, own, by_type, entity, kind):
        seen.update(own={r[0] for r in own.select(entity).collect()}, by_type={r[0] for r in by_type.select(kind).collect()}, entities=entities.collect())
        return real(model, entities, own, by_type, entity, kind)

    monkeypatch.setattr(clusters, "cluster_assign", spy)
    got = {r.segment_id for r in learning.cluster_profiles(tables).collect()}
    assert seen["own"] == got == {r.segment_id for r in seen["entities"]}
    assert seen["by_type"] == {r.road_type for r in seen["entities"]}
    assert any(i is not None and i % 10 == 7 for i in got) and 3 in seen["by_type"]


def test_profile_clusters_fall_back_to_the_type_then_to_an_empty_profile(spark):
    model = clusters.ProfileClusters(np.zeros(2), np.ones(2), np.eye(2), np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]))
    entities = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id int, kind int")
    own = spark.createDataFrame([(1, [9.0, 0.0])], "id int, vector array<double>")
    by_type = spark.createDataFrame([(0, [0.0, 9.0])], "kind int, vector array<double>")
    got = clusters.cluster_assign(model, entities, own, by_type, "id", "kind")
    assert {r.id: r.cluster for r in got.collect()} == {1: 1, 2: 2, 3: 0, 4: 0}


def test_terms_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "en", "a b A"), (2, "en", None), (3, "de", " -- "), (None, "de", "c c")], "id bigint, lang string, text string")
    got = text.doc_terms(docs, "id", "text", ["lang"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "en", "a", 2), (1, "en", "b", 1), (None, "de", "c", 2)], key=str)


def test_terms_of_repeated_documents_are_added_up(spark):
    rows = [(1, "en", "a b"), (1, "en", "b c"), (1, "de", "b"), (None, "en", "x"), (None, "en", "x y"), (7, None, "z"), (7, None, "z"), (8, "en", "q")]
    got = text.doc_terms(spark.createDataFrame(rows, "id bigint, lang string, text string").repartition(5), "id", "text", ["lang"])
    want = [(1, "en", "a", 1), (1, "en", "b", 2), (1, "en", "c", 1), (1, "de", "b", 1), (None, "en", "x", 2), (None, "en", "y", 1), (7, None, "z", 2), (8, "en", "q", 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_only_labelled_documents_are_cut(tables):
    """The join with the labels is below the cutting of texts."""
    p = learning.binary_points(tables)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in p.partition("Join")[0] and "regexp" not in p.partition("Join")[2]


def test_dense_rows_are_dealt_by_their_size(spark):
    rows = spark.range(1000).coalesce(1)
    assert models.dealt_for_dense(rows, 100, 80_000).rdd.getNumPartitions() == 10
    assert models.dealt_for_dense(rows, 100).rdd.getNumPartitions() == 1
