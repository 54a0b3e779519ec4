"""Models fitted on the driver tables; results depend on fixed seeds."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import textfn
from sparkloom.operators import clusters, evaluate, models, reshape, select, setops
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import REPORT_SQL, report, segments
from sparkloom.runtime import materialise, scratch_path

SIZE = 64
CLASSES = 10


def halves(t: Tables):
    """Training and test rows of the embeddings, split by a hash of the key."""
    inside = select.hash_share(F.col("vec_id")) < 0.75
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"))
    return rows.filter(inside), rows.filter(~inside)


def points(t: Tables, size: int | None = None):
    a, b = halves(t)
    return (models.as_points(a, "embedding", "label", ["vec_id"], size), models.as_points(b, "embedding", "label", ["vec_id"], size))


def binary_points(t: Tables):
    """Documents with text-shape features and their quality label."""
    shape = textfn.text_shape(F.col("text"), F.col("tokens"), F.col("sents"))
    known = t.docs.select("doc_id", "text").join(t.labels, "doc_id")  # the others are never cut
    cut = known.select("doc_id", "quality", "text", textfn.shape_tokens(F.col("text")).alias("tokens"), textfn.sentences(F.col("text")).alias("sents"))
    docs = cut.select("doc_id", "quality", F.array(*[c.cast("double") for c in shape.values()]).alias("v"))
    inside = select.hash_share(F.col("doc_id")) < 0.75
    return (models.as_points(docs.filter(inside), "v", "quality", ["doc_id"]), models.as_points(docs.filter(~inside), "v", "quality", ["doc_id"]))


@query()
def gaussian_generative(t: Tables) -> DataFrame:
    train, test = halves(t)
    return models.gaussian_generative(train, test, "embedding", "label", SIZE, 0.05)


@query()
def tune_gaussian(t: Tables) -> DataFrame:
    train, test = halves(t)
    return models.tune_gaussian(train, test, "embedding", "label", SIZE, [0.001, 0.01, 0.1, 1.0])


@query()
def gaussian_nb(t: Tables) -> DataFrame:
    train, test = points(t)
    return models.sweep(train, test, {"gaussian": models.gaussian_nb()})


@query("""WITH e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS training
  FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
m AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS v, count(*) AS n FROM e WHERE training GROUP BY ALL),
s AS (SELECT e.vec_id, m.label, ln(any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - (x - mu) ** 2 / (2 * v)) AS score FROM e JOIN m ON m.i = e.i WHERE NOT training GROUP BY ALL)
SELECT vec_id, label::BIGINT AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s) WHERE r = 1""")
def gaussian_nb_predictions(t: Tables) -> DataFrame:
    """Classes by independent Gaussians of each feature."""
    train, test = points(t)
    scored = models.gaussian_nb().fit(train).transform(test)
    return scored.select("vec_id", F.col("prediction").cast("bigint").alias("predicted"))


@query("""SELECT 1 AS k, round(sum(x * x) - sum(n * m * m), 4) AS cost FROM (SELECT i, count(*) AS n, avg(x) AS m, sum(x * x) AS x2, any_value(1) AS one, list(x) AS l FROM
  (SELECT i, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)) GROUP BY i), LATERAL (SELECT sqrt(x2) AS x)""")
def total_inertia(t: Tables) -> DataFrame:
    """Cost of a single cluster: the scatter around the mean."""
    rows = models.as_points(t.embeddings, "embedding", "label")
    return clusters.inertia_curve(rows, [1]).withColumn("cost", F.round("cost", 4))


@query()
def lda_classifier(t: Tables) -> DataFrame:
    train, test = halves(t)
    return models.lda_classifier(train, test, "embedding", "label", SIZE)


@query()
def logistic_regression_grid(t: Tables) -> DataFrame:
    train, _ = binary_points(t)
    return models.logistic_regression_grid(train, [0.001, 0.01, 0.1, 1.0])


VOCABULARIES = (100, 1000, 3000)


def _by_vocabulary(t: Tables, estimator, dense: bool = False) -> DataFrame:
    """Errors in telling the language of a document from its words, by size of the vocabulary."""
    docs = materialise(t.docs.select("doc_id", "lang", textfn.words(F.col("text")).alias("words")), "words")
    inside = select.hash_share(F.col("doc_id")) < 0.75
    parts = []
    for size in VOCABULARIES:
        train, test, words, classes = models.text_points(docs.filter(inside), docs.filter(~inside), "words", "lang", size)
        train = models.dealt_for_dense(train, words) if dense else train
        parts.append(models.sweep(train, test, {f"words={size}": estimator(words, classes)}))
    return setops.union_all(*parts)


@query()
def linear_svm_features(t: Tables) -> DataFrame:
    return _by_vocabulary(t, lambda words, classes: models.linear_svm())


@query()
def linear_svm_strength(t: Tables) -> DataFrame:
    train, test = points(t)
    return models.sweep(train, test, {f"reg={r}": models.linear_svm(r) for r in (0.001, 0.01, 0.1)}, gather=True)


@query()
def linear_perceptron_curve(t: Tables) -> DataFrame:
    return _by_vocabulary(t, models.linear_perceptron, dense=True)


@query()
def decision_tree(t: Tables) -> DataFrame:
    share = select.hash_share(F.col("vec_id"))
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").cast("bigint").alias("label"), share.alias("share"))
    train, valid, test = (models.as_points(rows.filter(c), "embedding", "label", ["vec_id"]) for c in ("share < 0.6", "share >= 0.6 and share < 0.8", "share >= 0.8"))
    return models.tune_and_refit(train, valid, test, {f"{i}, least {n}": models.decision_tree(i, n) for i in ("gini", "entropy") for n in (1, 5)})


@query()
def random_forest(t: Tables) -> DataFrame:
    train, test = points(t)
    return models.sweep(train, test, {f"depth={d}": models.random_forest(d) for d in (2, 5)}, True)


@query()
def extra_trees(t: Tables) -> DataFrame:
    train, test = points(t)
    return models.sweep(train, test, {"depth=5": models.extra_trees(5)}, True)


@query()
def gradient_boosting(t: Tables) -> DataFrame:
    """One class against the rest."""
    a, b = halves(t)
    train, test = (models.as_points(d.withColumn("label", evaluate.binarise(F.col("label"), 3)), "embedding", "label") for d in (a, b))
    return models.sweep(train, test, {f"depth={d}, rounds={n}, step={s}": models.gradient_boosting(d, n, s) for d, n, s in ((2, 20, 0.1), (3, 20, 0.3))}, True)


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def voted(t: Tables):
    """Line items with vote counts, split by order."""
    v = t.lineitem.select(*FEATURES, "l_orderkey", (F.col("l_quantity").cast("bigint") % 4).alias("total"))
    v = v.withColumn("helpful", F.least(F.col("total"), (F.col("l_linenumber") % 3).cast("bigint")))
    inside = select.hash_share(F.col("l_orderkey")) < 0.75
    return v.filter(inside), v.filter(~inside)


def _regression_sql(source: str, columns: list[str], group: str = "TRUE") -> str:
    """Least squares in SQL: ``p`` is the prediction of ``y`` for every row of ``source`` (columns, y, fit).

    Columns are made orthogonal one after the other on the rows to fit, so each
    coefficient is a quotient of two sums.
    """
    over = f"FILTER (WHERE fit) OVER (PARTITION BY {group})"
    out = f"(SELECT *, avg(y) {over} AS p{''.join(f', {c}::DOUBLE - avg({c}) {over} AS z{i}' for i, c in enumerate(columns))} FROM {source})"
    for k in range(len(columns)):
        slope = lambda v: f"coalesce(sum({v} * z{k}) {over} / nullif(sum(z{k} * z{k}) {over}, 0), 0)"  # noqa: B023,E731
        later = "".join(f", z{j} - z{k} * {slope(f'z{j}')} AS z{j}" for j in range(k + 1, len(columns)))
        drop = ", ".join(["p", *[f"z{j}" for j in range(k + 1, len(columns))]])
        out = f"(SELECT * EXCLUDE ({drop}), p + z{k} * {slope('(y - p)')} AS p{later} FROM {out})"
    return out


_LINES_SQL = """l AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, l_extendedprice AS y, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS fit FROM lineitem)"""


def _mse_sql(left: list[str]) -> str:
    return f"(SELECT avg((p - y) ** 2) FROM {_regression_sql('l', left)} WHERE NOT fit)"


def _subsets_sql() -> str:
    """(bits, mse): every set of features and its error on the rows left out."""
    sets = [(b, [f for i, f in enumerate(FEATURES) if b >> i & 1]) for b in range(1, 1 << len(FEATURES))]
    return "e AS (" + " UNION ALL ".join(f"SELECT {b} AS bits, {_mse_sql(s)} AS mse" for b, s in sets) + ")"


def _elimination_sql() -> str:
    names = "(VALUES " + ", ".join(f"({1 << i}, '{f}')" for i, f in enumerate(FEATURES)) + ") f(bit, name)"
    full = (1 << len(FEATURES)) - 1
    out = f"WITH {_LINES_SQL}, {_subsets_sql()}, s0 AS (SELECT 0 AS step, 'none' AS removed, bits, mse FROM e WHERE bits = {full})"
    for k in range(1, len(FEATURES)):
        out += f""", s{k} AS (SELECT {k} AS step, name AS removed, e.bits, e.mse FROM s{k - 1} b JOIN {names} ON b.bits & bit > 0
          JOIN e ON e.bits = b.bits - bit ORDER BY e.mse, name LIMIT 1), t{k} AS (SELECT s{k}.* FROM s{k}, s{k - 1} b WHERE s{k}.mse <= b.mse)"""
        out = out.replace(f"FROM s{k - 1} b JOIN", f"FROM {'s0' if k == 1 else f't{k - 1}'} b JOIN").replace(f", s{k - 1} b WHERE s{k}.mse", f", {'s0' if k == 1 else f't{k - 1}'} b WHERE s{k}.mse")
    return out + " " + " UNION ALL ".join(f"SELECT step, removed, round(mse, 2) AS mse FROM {'s0' if k == 0 else f't{k}'}" for k in range(len(FEATURES)))


@query()
def elastic_net(t: Tables) -> DataFrame:
    train, test = voted(t)
    return models.elastic_net_sweep(train, test, FEATURES, "total", "helpful", [0.001, 0.01, 0.1])


@query("""WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS training FROM lineitem),
m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v WHERE training)
SELECT round(avg((a + b * x - y) ** 2), 2) AS mse, round(avg(abs(a + b * x - y)), 4) AS mae FROM v, m WHERE NOT training""")
def least_squares(t: Tables) -> DataFrame:
    inside = select.hash_share(F.col("l_orderkey")) < 0.75
    out = models.least_squares(t.lineitem.filter(inside), t.lineitem.filter(~inside), ["l_quantity"], "l_extendedprice")
    return out.select(F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


_VOTED_SQL = """WITH l AS (SELECT *, (l_quantity::BIGINT % 4) AS total, ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS inside FROM lineitem),
h AS (SELECT *, least(total, l_linenumber % 3) AS helpful FROM l),
v AS (SELECT h.*, cut, total <= cut AS low, inside AND total > 0 AS fit, helpful / nullif(total, 0) AS y FROM h, (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS cut))
"""


@query(_VOTED_SQL + f"""SELECT cut AS threshold, round(avg(abs(round_even(greatest(0.0, least(1.0, p)) * total, 0) - helpful)), 6) AS mae
FROM {_regression_sql('v', FEATURES, 'cut, low')} WHERE NOT inside GROUP BY cut""")
def split_regression(t: Tables) -> DataFrame:
    train, test = voted(t)
    return models.split_regression(train, test, FEATURES, "total", "helpful", [1, 2]).withColumn("mae", F.round("mae", 6))


def _grams(t: Tables):
    inside = select.hash_share(F.col("l_orderkey")) < 0.75
    return (models.gram(t.lineitem.filter(inside), FEATURES, "l_extendedprice"), models.gram(t.lineitem.filter(~inside), FEATURES, "l_extendedprice"))


@query(f"WITH {_LINES_SQL} SELECT 'none' AS removed, round({_mse_sql(FEATURES)}, 2) AS mse" + "".join(
    f" UNION ALL SELECT '{f}', round({_mse_sql([x for x in FEATURES if x != f])}, 2)" for f in FEATURES))
def ablation(t: Tables) -> DataFrame:
    return models.ablation(*_grams(t), t.spark).withColumn("mse", F.round("mse", 2))


@query(_elimination_sql())
def backward_elimination(t: Tables) -> DataFrame:
    return models.backward_elimination(*_grams(t), t.spark).withColumn("mse", F.round("mse", 2))


_GAUSS_SQL = """WITH e AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.75 AS training
  FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
"""


@query(_GAUSS_SQL + """k AS (SELECT unnest([50, 150, 300]) AS n), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM (SELECT DISTINCT vec_id FROM e WHERE training)),
m AS (SELECT k.n, label, i, avg(x) AS mu, var_pop(x) AS v, count(*) AS c FROM e JOIN o USING (vec_id) JOIN k ON o.r <= k.n GROUP BY ALL),
g AS (SELECT n, max(v) AS most FROM (SELECT k.n, i, var_pop(x) AS v FROM e JOIN o USING (vec_id) JOIN k ON o.r <= k.n GROUP BY ALL) GROUP BY n),
s AS (SELECT m.n, e.vec_id, e.label, m.label AS guess, ln(any_value(c)) + sum(-0.5 * ln(2 * pi() * (v + 1e-9 * most)) - (x - mu) ** 2 / (2 * (v + 1e-9 * most))) AS score
  FROM e JOIN m ON m.i = e.i JOIN g ON g.n = m.n WHERE NOT training GROUP BY ALL)
SELECT n::BIGINT AS n, round(avg((label = guess)::INTEGER), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY n, vec_id ORDER BY score DESC, guess) AS r FROM s) WHERE r = 1 GROUP BY n""")
def learning_curve(t: Tables) -> DataFrame:
    train, test = points(t)
    return models.learning_curve(train, test, "vec_id", [50, 150, 300], models.gaussian_nb()).withColumn("accuracy", F.round("accuracy", 6))


# ---- clusters ---------------------------------------------------------------------------

@query()
def kmeans_inertia(t: Tables) -> DataFrame:
    rows = models.as_points(t.embeddings, "embedding", "label")
    return clusters.inertia_curve(rows, [1, 2, 5, 10, 20, 50, 100])


@query()
def mixture_choice(t: Tables) -> DataFrame:
    """AIC and BIC by number of components and kind of covariance, on whole vectors."""
    return clusters.mixture_choice(t.embeddings, "vec_id", "embedding", SIZE, [1, 2, 3, 4], clusters.COVARIANCES)


@query()
def mixture_of_classes(t: Tables) -> DataFrame:
    """Mixtures that start at the class means, and how well their components tell the classes."""
    return clusters.mixture_of_classes(t.embeddings, "embedding", "label", SIZE, clusters.COVARIANCES)


@query()
def cluster_bisecting(t: Tables) -> DataFrame:
    return clusters.cluster_by("Ward", t.embeddings, "vec_id", "embedding", 5)


@query()
def cluster_minibatch(t: Tables) -> DataFrame:
    """k-means whose centres are moved by one batch of rows after the other."""
    return clusters.cluster_by("MiniBatchKMeans", t.embeddings, "vec_id", "embedding", 5)


@query()
def cluster_spectral(t: Tables) -> DataFrame:
    return clusters.cluster_by("SpectralClustering", t.embeddings, "vec_id", "embedding", 5)


EPS, LEAST = 0.03125, 4


def segment_points(t: Tables) -> DataFrame:
    return segments(t).select("segment_id", F.array("lat1", "lon1").alias("v"))


@query("WITH RECURSIVE " + REPORT_SQL + f""", p AS (SELECT segment_id AS id, lat1 AS x, lon1 AS y FROM segment),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS}),
core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= {LEAST}),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
r(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON ce.a = r.id),
c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id)
SELECT p.id, coalesce(c.cluster, (SELECT min(k.cluster) FROM e JOIN c k ON k.id = e.b WHERE e.a = p.id), -1) AS cluster FROM p LEFT JOIN c ON c.id = p.id""")
def cluster_density(t: Tables) -> DataFrame:
    """Density clusters of segment positions; -1 is noise."""
    return clusters.dbscan(segment_points(t), "segment_id", "v", 2, EPS, LEAST)


@query()
def cluster_profiles(t: Tables) -> DataFrame:
    """Weekly profiles to clusters; segments without reports would go by road type, then by an empty profile."""
    rep = report(t).withColumn("road_type", (F.col("segment_id") % 4).cast("int"))
    own = reshape.pivot_profile(rep, "segment_id", "dow", "slot", "level", 120)
    by_type = reshape.pivot_profile(rep, "road_type", "dow", "slot", "level", 120)
    model = clusters.cluster_train(own, "segment_id", "vector", 84, 4)
    return clusters.cluster_assign(model, segments(t).select("segment_id", "road_type"), own, by_type, "segment_id", "road_type")


def _clustered(t: Tables):
    train, test = points(t)
    model = KMeans(k=3, seed=7).fit(train.select("features"))
    return [model.transform(d).withColumnRenamed("prediction", "cluster") for d in (train, test)]


@query()
def per_cluster_scores(t: Tables) -> DataFrame:
    train, test = _clustered(t)
    _, table = models.per_cluster_fit(train, test, "cluster", {"gaussian": models.gaussian_nb(), "tree": models.decision_tree("gini", 5)})
    return table


@query()
def ensemble_of_models(t: Tables) -> DataFrame:
    """Every cluster predicted by the algorithm that did best on it."""
    train, test = _clustered(t)
    fitted, table = models.per_cluster_fit(train, test, "cluster", {"gaussian": models.gaussian_nb(), "tree": models.decision_tree("gini", 5)})
    best = evaluate.best_model_per_cluster(table, "cluster")
    return models.ensemble_predict(test, "cluster", fitted, best).select("vec_id", "cluster", "label", "prediction")


@query(_GAUSS_SQL + """m AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS v, count(*) AS n FROM e WHERE training GROUP BY ALL),
s AS (SELECT e.vec_id, e.label, m.label AS guess, ln(any_value(n)) + sum(-0.5 * ln(2 * pi() * v) - (x - mu) ** 2 / (2 * v)) AS score FROM e JOIN m ON m.i = e.i WHERE NOT training GROUP BY ALL)
SELECT vec_id, label::DOUBLE AS label, guess::DOUBLE AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, guess) AS r FROM s) WHERE r = 1""")
def persisted_model(t: Tables) -> DataFrame:
    """A fitted model saved, loaded and applied."""
    train, test = points(t)
    path = scratch_path(t.spark, "model")
    models.persist_model(models.gaussian_nb().fit(train), path)
    return models.load_model(path).transform(test).select("vec_id", "label", "prediction")
