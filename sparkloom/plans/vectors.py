"""Linear algebra, statistics and neighbour search on vectors and series."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import aggregate, approximate, eigen, linalg, neighbours, select, sequence
from sparkloom.plans.profiles import prices
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.shapes import gappy_vectors
from sparkloom.plans.traffic import segments
from sparkloom.runtime import few_values, global_row_number, materialise

SIZE = 64
GAP_SQL = """gap AS (SELECT vec_id, label, i - 1 AS i, CASE WHEN (vec_id * 7 + (i - 1) * 13) % 11 <> 0 THEN embedding[i]::DOUBLE END AS x
  FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
mu AS (SELECT i, avg(x) AS m FROM gap GROUP BY i)
"""


@query("WITH " + GAP_SQL + """, p AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s, count(a.x * b.x) AS n FROM gap a JOIN gap b USING (vec_id) GROUP BY ALL)
SELECT i::INTEGER AS i, j::INTEGER AS j, n, round(s / n - ma.m * mb.m, 6) + 0.0 AS cov FROM p JOIN mu ma USING (i) JOIN mu mb ON mb.i = j""")
def nan_covariance(t: Tables) -> DataFrame:
    out = linalg.nan_covariance(gappy_vectors(t), "vector", SIZE)
    return out.select("i", "j", "n", (F.round("cov", 6) + 0.0).alias("cov"))


@query("WITH " + GAP_SQL + """SELECT round(sum(v), 6) AS total_variance FROM (SELECT i, avg(x * x) - avg(x) ** 2 AS v FROM gap GROUP BY i)""")
def pca_total_variance(t: Tables) -> DataFrame:
    """Eigenvalues add up to the variance of all positions."""
    table = linalg.fit_components(gappy_vectors(t), "vector", SIZE).table(t.spark)
    return table.agg(F.round(F.sum("eigenvalue"), 6).alias("total_variance"))


@query("""WITH v AS (SELECT l_linenumber AS line, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1)
SELECT line, value, round(sum(value) OVER (ORDER BY line) / sum(value) OVER (), 6) AS cum_share FROM v""")
def running_share(t: Tables) -> DataFrame:
    """Running share of a short list: the value of all first lines, second lines, and so on."""
    v = t.lineitem.groupBy(F.col("l_linenumber").alias("line")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return sequence.running_share(v, "line", "value").withColumn("cum_share", F.round("cum_share", 6))


@query()
def pca_components(t: Tables) -> DataFrame:
    """Components with their share and the running share of variance."""
    table = linalg.fit_components(gappy_vectors(t), "vector", SIZE).table(t.spark)
    return sequence.running_share(table, "component", "share").select("component", "eigenvalue", "share", "cum_share")


@query()
def pca_projection(t: Tables) -> DataFrame:
    """Coefficients on the leading three components, gaps filled by the mean."""
    v = gappy_vectors(t)
    fit = linalg.fit_components(v, "vector", SIZE)
    return linalg.project_residuals(v, "vector", fit.mean, fit.vectors[:3]).filter("res_mean < 1")


def _plain_basis() -> np.ndarray:
    """Two orthonormal vectors of equal entries, plain and alternating."""
    return np.array([[1 / 8] * SIZE, [1 / 8, -1 / 8] * (SIZE // 2)])


_FILLED = "WITH " + GAP_SQL + """, f AS (SELECT vec_id, i, coalesce(x, 0.25) AS x, 0.25::DOUBLE AS m, CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END::DOUBLE AS b FROM gap),
c AS (SELECT vec_id, sum((x - m) / 8) AS c1, sum((x - m) * b) AS c2, sum(x * x) AS e, sum((x - m) ** 2) AS r0 FROM f GROUP BY 1),
r AS (SELECT c.*, (SELECT 1) AS one FROM c), d AS (SELECT f.vec_id, sum((x - m - c1 / 8) ** 2) AS r1, sum((x - m - c1 / 8 - c2 * b) ** 2) AS r2 FROM f JOIN c USING (vec_id) GROUP BY 1)
"""


@query(_FILLED + """SELECT vec_id, round(c1, 6) + 0.0 AS coeff_1, round(c2, 6) + 0.0 AS coeff_2, round(e, 6) AS total_energy, round(r0 / e, 6) AS res_mean,
  round(r1 / r0, 6) AS res_1, round(r2 / r0, 6) AS res_2 FROM c JOIN d USING (vec_id)""")
def project_residuals(t: Tables) -> DataFrame:
    v = gappy_vectors(t).drop("label")
    out = linalg.project_residuals(v, "vector", np.full(SIZE, 0.25), _plain_basis())
    return out.select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in out.columns if c != "vec_id"])


@query(_FILLED + """SELECT vec_id, i::INTEGER AS idx, round(m + c1 / 8 + c2 * b, 6) + 0.0 AS value FROM f JOIN c USING (vec_id)""")
def reconstruct(t: Tables) -> DataFrame:
    mean, basis = np.full(SIZE, 0.25), _plain_basis()
    out = linalg.project_residuals(gappy_vectors(t).drop("label"), "vector", mean, basis)
    back = out.select("vec_id", linalg.reconstruct([F.col("coeff_1"), F.col("coeff_2")], mean, basis).alias("v"))
    return back.select("vec_id", F.posexplode("v").alias("idx", "value")).withColumn("value", F.round("value", 6) + 0.0)


DAILY_SQL = "daily AS (SELECT user_id, ts::DATE AS day, avg(value) AS v, sum(value) AS s FROM events GROUP BY ALL)\n"


def daily_means(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.sum("value").alias("s"))


@query("WITH " + DAILY_SQL + """, e AS (SELECT v, avg(v) OVER (PARTITION BY user_id) AS r, avg(v) OVER (PARTITION BY day) AS c FROM daily),
x AS (SELECT sqrt(avg(v * v)) AS a, sqrt(avg((v - r) ** 2)) AS b, sqrt(avg((v - c) ** 2)) AS d FROM e)
SELECT round(a, 6) AS rms_total, round(b, 6) AS rms_minus_row, round(d, 6) AS rms_minus_col, round(1 - (b / a) ** 2, 6) AS row_explained, round(1 - (d / a) ** 2, 6) AS col_explained FROM x""")
def two_way_effects(t: Tables) -> DataFrame:
    out = linalg.two_way_effects(daily_means(t), "user_id", "day", "v")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_ROUNDS = 10


@query("WITH " + DAILY_SQL + ", r0 AS (SELECT DISTINCT user_id, 0.0::DOUBLE AS r FROM daily), c0 AS (SELECT DISTINCT day, 0.0::DOUBLE AS c FROM daily)" + "".join(
    f""", r{k} AS (SELECT user_id, avg(v - c) AS r FROM daily JOIN c{k - 1} USING (day) GROUP BY 1), c{k} AS (SELECT day, avg(v - r) AS c FROM daily JOIN r{k} USING (user_id) GROUP BY 1)"""
    for k in range(1, _ROUNDS + 1)) + " UNION ALL ".join(
    f" SELECT {k} AS round, round(sqrt(avg((v - r - c) ** 2)), 6) AS rms FROM daily JOIN r{k} USING (user_id) JOIN c{k} USING (day)" for k in range(1, _ROUNDS + 1)))
def alternating_effects(t: Tables) -> DataFrame:
    return linalg.alternating_effects(daily_means(t), "user_id", "day", "v", _ROUNDS).withColumn("rms", F.round("rms", 6))


@query("WITH " + DAILY_SQL + """, d AS (SELECT user_id, day, (s > 40)::INTEGER AS f FROM daily),
p AS (SELECT a.user_id AS i, b.user_id AS j, count(*) AS m, sum(a.f)::BIGINT AS n1, sum(b.f)::BIGINT AS n2, sum(a.f * b.f)::BIGINT AS l
  FROM d a JOIN d b ON a.day = b.day AND a.user_id < b.user_id GROUP BY ALL),
g AS (SELECT *, (-lgamma(l + 1) - lgamma(n1 - l + 1) - lgamma(n2 - l + 1) - lgamma(m - n1 - n2 + l + 1) - lgamma(m + 1) + lgamma(n1 + 1) + lgamma(m - n1 + 1)
  + lgamma(n2 + 1) + lgamma(m - n2 + 1)) / m AS lp FROM p)
SELECT i, j, m, n1, n2, l, CASE WHEN m >= 20 THEN round(lp, 6) + 0.0 END AS log_p FROM g""")
def overlap_significance(t: Tables) -> DataFrame:
    return overlaps(t).withColumn("log_p", _rounded("log_p", 6))


def _rounded(value: str, digits: int) -> Column:
    """Rounded halves up, in plain arithmetic: ``F.round`` goes through a decimal, which costs more per pair than all else."""
    x, unit = F.col(value), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit + 0.0


def overlaps(t: Tables, **form) -> DataFrame | linalg.BlockPairs:
    d = daily_means(t).select(F.col("user_id").alias("e"), "day", (F.col("s") > 40).cast("int").alias("f"))
    return linalg.overlap_significance(d, "e", "day", "f", 20, **form)


@query()
def spectral_order(t: Tables) -> DataFrame:
    """Entities ordered by an eigenvector, joined back to their coordinates."""
    order = eigen.spectral_order(overlaps(t, in_blocks=True, width=2048), "log_p")
    return order.join(segments(t), F.col("entity") == F.col("segment_id")).select("segment_id", "lat1", "lon1", "loading", "position")


# ---- series --------------------------------------------------------------------

def event_series(t: Tables) -> DataFrame:
    """Values of each event type in time order with an index from 0."""
    rows = global_row_number(t.events.select("event_type", "ts", "event_id", "value"), ["event_type", "ts", "event_id"], "rn")
    first = rows.groupBy("event_type").agg(F.min("rn").alias("lo"))
    return materialise(rows.join(first, "event_type").select("event_type", (F.col("rn") - F.col("lo")).alias("idx"), "value"), "series")


def _boxes_sql(n: int, op: str) -> str:
    """Column by column: boxes that hold a value, and boxes between the least and the greatest value of the column."""
    return f"""(WITH k AS (SELECT event_type, y0, (y1 - y0) / {n} AS h FROM ext),
  v AS (SELECT s.event_type, floor(((s.idx + 1) * {n} - 1) / s.cnt) AS c, s.value, k.y0, k.h FROM ser s JOIN k ON k.event_type = s.event_type),
  m AS (SELECT event_type, c, min(value) AS lo, max(value) AS hi, any_value(y0) AS y0, any_value(h) AS h FROM v GROUP BY event_type, c),
  b AS (SELECT event_type, c, floor((value - y0) / h)::BIGINT AS b FROM v
    UNION SELECT event_type, c, b FROM (SELECT *, unnest(range(floor((lo - y0) / h)::BIGINT, floor((hi - y0) / h)::BIGINT + 1)) AS b FROM m) WHERE lo <= y0 + b * h AND hi {op} y0 + (b + 1) * h)
  SELECT event_type, count(*) AS n FROM b WHERE b < {n} GROUP BY event_type)"""


@query("""WITH ser AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS cnt FROM events),
ext AS (SELECT event_type, min(value) AS y0, max(value) AS y1 FROM events GROUP BY 1)
SELECT event_type, a.n AS n_large, b.n AS n_small, round((ln(b.n) - ln(a.n)) / (ln(2048) - ln(32)), 6) AS dimension FROM """
       + _boxes_sql(32, ">") + " a JOIN " + _boxes_sql(2048, ">=") + " b USING (event_type)")
def box_count_dimension(t: Tables) -> DataFrame:
    out = linalg.box_count_dimension(event_series(t), "event_type", "idx", "value")
    return out.withColumn("dimension", F.round("dimension", 6))


_HOURS = "(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)))"


@query(f"""WITH s AS (SELECT {_HOURS} AS i, count(*)::DOUBLE AS v FROM events GROUP BY 1), k AS (SELECT unnest(range(0, 7)) AS term)
SELECT term::INTEGER AS term, round(sum(v * CASE WHEN term = 0 THEN 1 / sqrt(720) WHEN term % 2 = 1 THEN sqrt(2 / 720) * sin(2 * pi() * ((term + 1) // 2) * i / 720)
  ELSE sqrt(2 / 720) * cos(2 * pi() * (term // 2) * i / 720) END), 5) + 0.0 AS coefficient FROM s, k GROUP BY 1""")
def fourier_coefficients(t: Tables) -> DataFrame:
    out = linalg.fourier_project(hourly(t), "i", "v", 720, 3)
    return out.withColumn("coefficient", F.round("coefficient", 5) + 0.0)


def hourly(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.events.groupBy(F.timestamp_diff("HOUR", start, F.col("ts")).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query(f"""WITH s AS (SELECT {_HOURS} AS i, count(*)::DOUBLE AS v FROM events GROUP BY 1), k AS (SELECT unnest(range(0, 7)) AS term),
c AS (SELECT ((term + 1) // 2) AS f, sum(v * CASE WHEN term = 0 THEN 1 / sqrt(720) WHEN term % 2 = 1 THEN sqrt(2 / 720) * sin(2 * pi() * ((term + 1) // 2) * i / 720)
  ELSE sqrt(2 / 720) * cos(2 * pi() * (term // 2) * i / 720) END) AS x FROM s, k GROUP BY term),
e AS (SELECT f, sum(x * x) AS e FROM c GROUP BY 1)
SELECT f::INTEGER AS frequency, round(sqrt((SELECT sum(v * v) FROM s) - sum(e) OVER (ORDER BY f)), 5) AS error FROM e""")
def fourier_error(t: Tables) -> DataFrame:
    s = hourly(t)
    return linalg.projection_error(s, "v", linalg.fourier_project(s, "i", "v", 720, 3)).withColumn("error", F.round("error", 5))


@query("SELECT floor(value / 10) * 10 AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    out = linalg.histogram(t.events, "value", 10.0)
    return out.withColumn("bin", F.col("bin").cast("double"))


@query("""SELECT event_id, round(3 ** (1 + event_id % 5)::DOUBLE, 4) AS weight, CASE WHEN value > (SELECT avg(value) FROM events) THEN 'above' ELSE 'below' END AS side FROM events""")
def marker_weight(t: Tables) -> DataFrame:
    mean = t.events.agg(F.avg("value")).scalar()
    return t.events.select("event_id", F.round(F.pow(F.lit(3.0), 1 + F.col("event_id") % 5), 4).alias("weight"),
                           F.when(F.col("value") > mean, "above").otherwise("below").alias("side"))


# Date ranges shown as weekly slices.
SLICES = [("w1", "2024-01-01", "2024-01-07"), ("w2", "2024-01-08", "2024-01-14"), ("w3", "2024-01-15", "2024-01-21")]


@query("""SELECT event_id, name FROM events JOIN (VALUES """ + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in SLICES)
       + ") r(name, lo, hi) ON ts::DATE BETWEEN lo AND hi")
def weekly_slices(t: Tables) -> DataFrame:
    """Ranges become their days, so the range join is an equi-join on the day."""
    rows = ", ".join(f"('{a}', date'{b}', date'{c}')" for a, b, c in SLICES)
    days = t.spark.sql(f"SELECT name, explode(sequence(lo, hi)) AS day FROM VALUES {rows} AS v(name, lo, hi)")
    return t.events.select("event_id", F.to_date("ts").alias("day")).join(days, "day").select("event_id", "name")


@query("""WITH s AS (SELECT count(*) FILTER (WHERE h) AS n1, count(*) FILTER (WHERE NOT h) AS n2, avg(v) FILTER (WHERE h) AS m1, avg(v) FILTER (WHERE NOT h) AS m2,
  var_samp(v) FILTER (WHERE h) AS v1, var_samp(v) FILTER (WHERE NOT h) AS v2 FROM (SELECT value AS v, user_id % 2 = 0 AS h FROM events))
SELECT n1, n2, n1 + n2 - 2 AS dof, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) + 0.0 AS t FROM s""")
def t_test_independent(t: Tables) -> DataFrame:
    out = linalg.t_test_independent(t.events, "value", F.col("user_id") % 2 == 0)
    return out.withColumn("t", F.round("t", 6) + 0.0)


def _paired(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    return t.orders.groupBy("o_custkey").agg(F.avg(F.when(y == 1996, F.col("o_totalprice"))).alias("a"), F.avg(F.when(y == 1997, F.col("o_totalprice"))).alias("b"))


@query("""WITH p AS (SELECT avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) - avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS d FROM orders GROUP BY o_custkey)
SELECT count(d) AS n, count(d) - 1 AS dof, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) + 0.0 AS t FROM p""")
def t_test_paired(t: Tables) -> DataFrame:
    return linalg.t_test_paired(_paired(t), "a", "b").withColumn("t", F.round("t", 6) + 0.0)


@query()
def t_test_p_values(t: Tables) -> DataFrame:
    rows = [("independent", *linalg.t_test_independent_p(t.events, "value", F.col("user_id") % 2 == 0)), ("paired", *linalg.t_test_paired_p(_paired(t), "o_custkey", "a", "b"))]
    return t.spark.createDataFrame(rows, "test string, t double, p_value double")


_CHI_SQL = """WITH o AS (SELECT event_type, user_id % 3 AS g, count(*) AS o FROM events GROUP BY ALL), r AS (SELECT event_type, sum(o) AS r FROM o GROUP BY 1),
c AS (SELECT g, sum(o) AS c FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o),
e AS (SELECT coalesce(o, 0) AS o, r * c / n AS e FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN o ON o.event_type = r.event_type AND o.g = c.g)
"""


@query(_CHI_SQL + "SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof FROM e")
def chi_square(t: Tables) -> DataFrame:
    return _chi(t).withColumn("statistic", F.round("statistic", 6))


def _chi(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return linalg.chi_square(counts, "event_type", "g", "n")


@query()
def chi_square_p_value(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 3).alias("g"))
    return t.spark.createDataFrame([linalg.chi_square_p(rows, "event_type", "g")], "statistic double, dof int, p_value double")


# ---- neighbours -------------------------------------------------------------------

_NEAR = """WITH e AS (SELECT vec_id, label, list_transform(range(1, 4), lambda i: embedding[i]::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS cid, b.label, list_distance(a.v, b.v) AS d FROM e a CROSS JOIN e b)
SELECT qid, cid, label, round(d * d, 6) AS squared, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, cid)::INTEGER AS rank FROM p) WHERE rank <= 11"""


@query(_NEAR)
def nearest_in_space(t: Tables) -> DataFrame:
    """Eleven nearest rows (self included) in the first three dimensions, with their class."""
    flat = t.vectors.select("vec_id", "label", F.slice("embedding", 1, 3).alias("v"))
    near = neighbours.knn_join(flat, flat, "vec_id", "v", 11)
    return near.join(flat.select(F.col("vec_id").alias("cid"), "label"), "cid").select(
        "qid", "cid", "label", F.round(F.col("distance") * F.col("distance"), 6).alias("squared"), "rank")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.vec_id AS cid, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT qid, cid, round(s, 6) + 0.0 AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid)::INTEGER AS rank FROM p) WHERE rank <= 3""")
def cosine_neighbours(t: Tables) -> DataFrame:
    return neighbours.cosine_neighbours(t.vectors, "vec_id", "embedding", 3).withColumn("cosine", F.round("cosine", 6) + 0.0)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id
ORDER BY list_cosine_similarity(a.v, b.v) DESC, a, b LIMIT 10""")
def closest_pairs(t: Tables) -> DataFrame:
    return neighbours.closest_pairs(t.vectors, "vec_id", "embedding", 10).withColumn("cosine", F.round("cosine", 6) + 0.0)


def asked_vectors(t: Tables) -> DataFrame:
    """The stated query set of the approximate search: every fiftieth vector."""
    return t.vectors.where("vec_id % 50 = 0")


@query()
def approximate_neighbours(t: Tables) -> DataFrame:
    """About the ten most similar vectors of each asked one, found through hash tables."""
    return approximate.approximate_cosine(asked_vectors(t), t.vectors, "vec_id", "embedding", 10)


@query("""SELECT count(*) AS asked, count(*) * 10 AS wanted, true AS reached FROM embeddings WHERE vec_id % 50 = 0""")
def approximate_recall(t: Tables) -> DataFrame:
    """Whether nine tenths of the true neighbours come out, measured against the exact search."""
    exact = neighbours.knn_join(neighbours.unit_vectors(asked_vectors(t), "embedding"), neighbours.unit_vectors(t.vectors, "embedding"), "vec_id", "embedding", 11)
    exact = exact.where("qid <> cid and rank <= 11").select("qid", "cid")
    met = exact.join(approximate_neighbours(t).select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
    return met.agg(F.count_distinct("qid").alias("asked"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("reached"))


@query()
def approximate_votes(t: Tables) -> DataFrame:
    """Classes of held-out vectors by the votes of their approximate neighbours."""
    inside = select.hash_share(F.col("vec_id")) < 0.8
    near = approximate.approximate_join(t.vectors.filter(~inside), t.vectors.filter(inside), "vec_id", "embedding", 5)
    return neighbours.knn_votes(near, t.embeddings, "vec_id", "label", [1, 3, 5])


def _knn_sql(metric: str) -> str:
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.8 AS training FROM embeddings),
p AS (SELECT a.vec_id AS qid, b.label, b.vec_id AS cid, {metric} AS d FROM e a JOIN e b ON NOT a.training AND b.training),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, cid) AS rank FROM p),
v AS (SELECT qid, k, label, count(*) AS n FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL)
SELECT qid, k, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY n DESC, label) AS o FROM v) WHERE o = 1"""


def knn_predictions(t: Tables, metric: str, sizes: list[int]) -> DataFrame:
    inside = select.hash_share(F.col("vec_id")) < 0.8
    train, test = t.vectors.filter(inside), t.vectors.filter(~inside)
    near = neighbours.knn_join(test, train, "vec_id", "embedding", max(sizes), metric)
    return neighbours.knn_votes(near, t.embeddings, "vec_id", "label", sizes)


@query(_knn_sql("list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"))
def knn_manhattan(t: Tables) -> DataFrame:
    return knn_predictions(t, "l1", [1, 3, 5])


@query(_knn_sql("list_distance(a.v, b.v)"))
def knn_euclidean(t: Tables) -> DataFrame:
    return knn_predictions(t, "l2", [1, 3, 5])


@query(_knn_sql("list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"))
def knn_chebyshev(t: Tables) -> DataFrame:
    return knn_predictions(t, "linf", [1, 3, 5])


@query("WITH " + """price AS (SELECT ts::DATE AS date, event_type AS ticker, round(avg(value), 6) AS price FROM events GROUP BY ALL),
d AS (SELECT ticker, date, ln(lead(price) OVER (PARTITION BY ticker ORDER BY date) / price) AS diff FROM price)
SELECT a.ticker AS x, b.ticker AS y, round(corr(a.diff, b.diff), 6) + 0.0 AS corr FROM d a JOIN d b USING (date) WHERE a.ticker < b.ticker GROUP BY ALL""")
def market_correlations(t: Tables) -> DataFrame:
    """Correlation of the daily changes of every ticker pair, from one aligned table."""
    diffs = sequence.log_diff(prices(t), ["ticker"], "date", "price", F.trunc("date", "month"))
    names = few_values(t.events, "event_type")
    wide = diffs.groupBy("date").pivot("ticker", names).agg(F.first("diff"))
    out = aggregate.pairwise(wide, names).filter("x <> y")
    return out.select("x", "y", (F.round("corr", 6) + 0.0).alias("corr"))
