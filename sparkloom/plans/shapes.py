"""Scalar functions, nested data and layouts over the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import arrays, textfn
from sparkloom.operators import aggregate, reshape, sequence
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import REPORT_SQL, report, text

# ---- arrays and records -------------------------------------------------------


@query("""SELECT l_orderkey, n, count(*) AS c FROM (SELECT l_orderkey, unnest(range(1, l_linenumber + 1)) AS n FROM lineitem) GROUP BY ALL""")
def explode_range(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", arrays.explode_range(F.col("l_linenumber")).alias("n"))
    return rows.groupBy("l_orderkey", "n").agg(F.count(F.lit(1)).alias("c"))


@query("""SELECT vec_id, len(list_filter(e, lambda x: cos(x * 10) > 0))::INTEGER AS n_positive, round(list_sum(list_transform(e, lambda x: cos(x * 10))), 6) + 0.0 AS cos_sum
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def cosine_lists(t: Tables) -> DataFrame:
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10)
    base = t.embeddings.select("vec_id", e.alias("e"))
    return base.select("vec_id", F.size(arrays.positive_cos(F.col("e"))).alias("n_positive"),
                       (F.round(F.aggregate(arrays.map_cos(F.col("e")), F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("cos_sum"))


@query(r"""SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'the')) > 0 AS doubled FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
def adjacent_equal(t: Tables) -> DataFrame:
    """Documents in which a word is directly repeated."""
    w = t.docs.select("doc_id", textfn.words(F.col("text")).alias("w"))
    return w.select("doc_id", sequence.adjacent_equal(F.col("w"), "the").alias("doubled"))


@query("""SELECT p_partkey, CASE WHEN p_type = p_brand THEN 1 ELSE 2 END + len(list_filter(string_split(p_name, ' '), lambda w: w <> p_type AND w <> p_brand))::INTEGER AS n_labels,
  2 AS n_lists FROM (SELECT p_partkey, p_type, p_brand, array_to_string(list_distinct(string_split(p_name, ' ')), ' ') AS p_name FROM part)""")
def flatten_labels(t: Tables) -> DataFrame:
    cats = categories(t)
    return cats.select("p_partkey", F.size(arrays.flatten_labels(F.col("categories"))).alias("n_labels"), F.size("categories").alias("n_lists"))


def categories(t: Tables) -> DataFrame:
    """Parts with their labels as lists of lists."""
    return t.part.select("p_partkey", F.array(F.array("p_type", "p_brand"), F.split("p_name", " ")).alias("categories"))


LABEL_SQL = """labels_of AS (SELECT DISTINCT p_partkey, label FROM (SELECT p_partkey, p_type AS label FROM part UNION ALL SELECT p_partkey, p_brand FROM part
  UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part))
"""


def top_labels(t: Tables, n: int) -> DataFrame:
    flat = categories(t).select(F.explode(arrays.flatten_labels(F.col("categories"))).alias("label"))
    return flat.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(n)


@query("WITH " + LABEL_SQL + "SELECT label, count(*) AS n FROM labels_of GROUP BY label ORDER BY n DESC, label LIMIT 10")
def most_used_labels(t: Tables) -> DataFrame:
    return top_labels(t, 10)


@query("WITH " + LABEL_SQL + """, top AS (SELECT label, count(*) AS n FROM labels_of GROUP BY label ORDER BY n DESC, label LIMIT 4),
r AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) AS k FROM top)
SELECT p_partkey, """ + ", ".join(f"max((k = {k})::INTEGER) AS top_{k}" for k in range(1, 5)) + """ FROM (
  SELECT p.p_partkey, coalesce(k, 0) AS k FROM part p LEFT JOIN (SELECT p_partkey, k FROM labels_of JOIN r USING (label)) USING (p_partkey)) GROUP BY p_partkey""")
def one_hot_labels(t: Tables) -> DataFrame:
    """A 0/1 column for each of the four most used labels."""
    wanted = [r["label"] for r in top_labels(t, 4).collect()]
    flat = categories(t).select("p_partkey", arrays.flatten_labels(F.col("categories")).alias("l"))
    return flat.select("p_partkey", *[c.alias(f"top_{i}") for i, c in enumerate(arrays.one_hot(F.col("l"), wanted), 1)])


@query("""SELECT doc_id, source AS user, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5""")
def parse_json_safe(t: Tables) -> DataFrame:
    """JSON lines, some cut short and some of a foreign kind; those without a user are dropped."""
    good = F.to_json(F.struct("doc_id", "text", F.struct(F.col("source").alias("id_str")).alias("user")))
    line = (F.when(F.col("doc_id") % 7 == 3, F.substring(good, 1, 12)).when(F.col("doc_id") % 11 == 5, F.lit('{"limit": {"track": 5}}')).otherwise(good))
    parsed = t.docs.select(line.alias("line")).select(
        F.from_json("line", "doc_id bigint, text string, user struct<id_str string>", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.filter(F.col("r.user.id_str").isNotNull()).select(
        "r.doc_id", F.col("r.user.id_str").alias("user"), F.length("r.text").cast("bigint").alias("n_chars"), F.md5("r.text").alias("digest"))


@query("""SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, round(json_extract(props, '$.k')::INTEGER / 100, 6) AS ratio FROM events""")
def struct_fields(t: Tables) -> DataFrame:
    parsed = t.events.select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", "p.k", F.round(F.col("p.k") / 100, 6).alias("ratio"))


@query("SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def pack_unpack(t: Tables) -> DataFrame:
    packed = t.embeddings.select("vec_id", arrays.pack_array("embedding").alias("b"))
    back = packed.select("vec_id", arrays.unpack_array("b").alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS flag, l_quantity + l_discount + l_tax AS total, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_partkey END AS part FROM lineitem""")
def parse_csv_record(t: Tables) -> DataFrame:
    """Typed records with an array field and dirty numbers."""
    part = F.when(F.col("l_orderkey") % 4 == 0, F.lit("?")).otherwise(F.col("l_partkey").cast("string"))
    lines = t.lineitem.select(F.concat_ws(",", "l_orderkey", "l_linenumber", part, "l_quantity", "l_discount", "l_tax", "l_returnflag").alias("line"))
    rules = [("l_orderkey", "bigint", 1), ("l_linenumber", "int", 1), ("part", "bigint", 1), ("nums", "double", 3), ("flag", "string", 1)]
    rec = lines.select(*arrays.parse_csv_record(F.col("line"), rules))
    return rec.select("l_orderkey", "l_linenumber", "flag", (F.col("nums")[0] + F.col("nums")[1] + F.col("nums")[2]).alias("total"), "part")


@query("""SELECT o_orderkey, o_totalprice AS value FROM orders WHERE o_orderpriority = '1-URGENT'""")
def extract_log_values(t: Tables) -> DataFrame:
    """Log lines filtered by pattern, the number read and sorted as a number."""
    lines = t.orders.select(F.concat(F.lit("["), "o_orderpriority", F.lit("] order "), F.col("o_orderkey").cast("string"), F.lit(" took "),
                                     F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ms")).alias("line"))
    hit = lines.filter(F.col("line").contains("[1-URGENT]"))
    return hit.select(F.regexp_extract("line", r"order (\d+)", 1).cast("bigint").alias("o_orderkey"),
                      F.regexp_extract("line", r"took ([0-9.]+)", 1).cast("double").alias("value")).orderBy("value", "o_orderkey")


# ---- numbers --------------------------------------------------------------------

@query("""WITH p AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem WHERE l_orderkey % 10 < 8)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity, round((l_tax - mt) / st, 6) + 0.0 AS l_tax FROM lineitem, p""")
def zscore(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax")
    out = reshape.zscore(rows, ["l_quantity", "l_tax"], F.col("l_orderkey") % 10 < 8)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[(F.round(c, 6) + 0.0).alias(c) for c in ("l_quantity", "l_tax")])


@query("""WITH g AS (SELECT p_partkey, nullif(p_size % 7, 0) AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part)
SELECT p_partkey, coalesce(size, -1) AS size, round(coalesce(price, (SELECT avg(price) FROM g)), 4) AS price FROM g""")
def fill_defaults(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("size"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"))
    return reshape.fill_with_mean(rows.na.fill({"size": -1}), ["price"]).withColumn("price", F.round("price", 4))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 50 - 0.1))::DOUBLE AS clipped, round_even(value, 0)::DOUBLE AS rounded FROM events")
def clip_and_round(t: Tables) -> DataFrame:
    return t.events.select("event_id", arrays.clip(F.col("value") / 50 - 0.1, 0.0, 1.0).alias("clipped"), F.bround("value", 0).alias("rounded"))


@query("""WITH m AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1996) AS a, sum(o_totalprice) FILTER (WHERE year(o_orderdate) = 1997) AS b FROM orders GROUP BY 1)
SELECT o_custkey, round(b / a, 6) AS ratio, round(ln(b / a), 6) + 0.0 AS ln_ratio, round(log2(b / a), 6) + 0.0 AS log2_ratio, round(log10(b / a), 6) + 0.0 AS log10_ratio FROM m""")
def change_ratios(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    m = t.orders.groupBy("o_custkey").agg(F.sum(F.when(y == 1996, F.col("o_totalprice"))).alias("a"), F.sum(F.when(y == 1997, F.col("o_totalprice"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("o_custkey", F.round(arrays.change_ratio(b, a), 6).alias("ratio"),
                    *[(F.round(arrays.log_ratio(b, a, base), 6) + 0.0).alias(n) for n, base in (("ln_ratio", None), ("log2_ratio", 2), ("log10_ratio", 10))])


@query("SELECT event_id, round(CASE WHEN event_type IN ('click', 'view') THEN value / 10 ELSE value END, 6) AS value FROM events")
def unit_scale(t: Tables) -> DataFrame:
    """Measurements stored in tenths brought to units."""
    return t.events.select("event_id", F.round(F.when(F.col("event_type").isin("click", "view"), F.col("value") / 10).otherwise(F.col("value")), 6).alias("value"))


# ---- layouts ----------------------------------------------------------------------

PROFILE_SQL = "WITH " + REPORT_SQL + """, f AS (SELECT {key} AS k, (dow * 48 + slot // 30) AS idx, avg(level) AS v FROM report {join} GROUP BY ALL),
full_ AS (SELECT k, idx, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT k FROM f) a CROSS JOIN (SELECT unnest(range(0, 336)) AS idx) b LEFT JOIN f USING (k, idx))
"""


@query(PROFILE_SQL.format(key="segment_id", join="") + "SELECT k AS segment_id, idx::INTEGER AS idx, round(v, 6) AS value FROM full_")
def pivot_profile(t: Tables) -> DataFrame:
    """Weekly profile of each segment, 336 half-hour slots, 0 where nothing was reported."""
    v = reshape.pivot_profile(report(t), "segment_id", "dow", "slot", "level", 30)
    return v.select("segment_id", F.posexplode("vector").alias("idx", "value")).withColumn("value", F.round("value", 6))


@query(PROFILE_SQL.format(key="road_type", join="JOIN segment USING (segment_id)") + """, s AS (SELECT idx, avg(v) AS m, stddev_pop(v) AS d FROM full_ GROUP BY 1)
SELECT k AS road_type, idx::INTEGER AS idx, round(CASE WHEN d > 0 THEN (v - m) / d ELSE 0.0 END, 6) + 0.0 AS value FROM full_ JOIN s USING (idx)""")
def pivot_profile_by_road_type(t: Tables) -> DataFrame:
    rows = report(t).withColumn("road_type", (F.col("segment_id") % 4).cast("int"))
    v = reshape.pivot_profile(rows, "road_type", "dow", "slot", "level", 30)
    return reshape.standardise_vectors(v, "road_type", "vector").withColumn("value", F.round("value", 6) + 0.0)


@query("WITH " + REPORT_SQL + """SELECT segment_id, date_diff('day', (SELECT min(date) FROM report), date)::INTEGER AS date_idx, slot AS time_idx, round(avg(level), 6) AS value
FROM report GROUP BY ALL""")
def pivot_long_series(t: Tables) -> DataFrame:
    rep = report(t)
    first = rep.agg(F.min("date")).scalar()
    rows = rep.select("segment_id", F.datediff("date", first).alias("date_idx"), F.col("slot").alias("time_idx"), "level")
    return reshape.pivot_long_series(rows, "segment_id", "date_idx", "time_idx", "level").withColumn("value", F.round("value", 6))


@query("WITH " + REPORT_SQL + """SELECT event_id, level, round(avg(level) OVER (PARTITION BY segment_id), 6) AS mean_level, round(avg(slot) OVER (PARTITION BY segment_id), 4) AS mean_slot FROM report""")
def nonsparse_profile(t: Tables) -> DataFrame:
    out = reshape.with_group_means(report(t).select("event_id", "segment_id", "level", "slot"), ["segment_id"], ["level", "slot"])
    return out.select("event_id", "level", F.round("mean_level", 6).alias("mean_level"), F.round("mean_slot", 4).alias("mean_slot"))


@query("""SELECT year(o_orderdate)::INTEGER AS year, """ + ", ".join(
    f"round(avg(o_totalprice) FILTER (WHERE c_nationkey = {n}), 6) AS n{n}" for n in range(25)) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pivot_year_station(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.year("o_orderdate").alias("year"), "c_nationkey", "o_totalprice")
    wide = reshape.pivot_table(rows, "year", "c_nationkey", list(range(25)), "o_totalprice")
    return wide.select("year", *[F.round(str(n), 6).alias(f"n{n}") for n in range(25)])


@query("""SELECT p_partkey, name, value FROM (SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part)""")
def unpivot_measures(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return reshape.unpivot(rows, ["p_partkey"], ["size", "price"])


@query("SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part")
def repivot_measures(t: Tables) -> DataFrame:
    return reshape.repivot(unpivot_measures(t), ["p_partkey"], "name", ["size", "price"], "value")


@query("WITH " + REPORT_SQL + """, m AS (SELECT segment_id, dow, slot, avg(level) AS v FROM report GROUP BY ALL)
SELECT segment_id, dow, count(*)::INTEGER AS n, string_agg((v * 60)::BIGINT::VARCHAR, ',' ORDER BY slot) AS series FROM m GROUP BY ALL""")
def series_by_weekday(t: Tables) -> DataFrame:
    s = reshape.series_by_weekday(report(t), "segment_id", "dow", "slot", "level")
    long = s.select("segment_id", F.explode("series").alias("dow", "v"))
    return long.select("segment_id", "dow", F.size("v").alias("n"), F.array_join(F.transform("v", lambda x: F.bround(x * 60).cast("bigint").cast("string")), ",").alias("series"))


@query("""SELECT vec_id, (make_date(2000 + label, 1, 1) + (i - 1)::INTEGER)::DATE::VARCHAR AS date, round(embedding[i]::DOUBLE, 6) + 0.0 AS value
FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings) WHERE (vec_id * 7 + (i - 1) * 13) % 11 <> 0""")
def vectors_to_daily(t: Tables) -> DataFrame:
    rows = gappy_vectors(t).select("vec_id", (2000 + F.col("label")).cast("int").alias("year"), "vector")
    out = reshape.vectors_to_daily(rows, ["vec_id"], "year", "vector")
    return text(out.select("vec_id", "date", (F.round("value", 6) + 0.0).alias("value")))


def gappy_vectors(t: Tables) -> DataFrame:
    """Embeddings with gaps at positions fixed by arithmetic; gaps are NULL."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") * 7 + i * 13) % 11 != 0, x))
    return t.vectors.select("vec_id", "label", v.alias("vector"))


@query("""SELECT n_gaps, count(*) AS n_rows FROM (SELECT vec_id, len(list_filter(range(0, 64), lambda i: (vec_id * 7 + i * 13) % 11 = 0))::INTEGER AS n_gaps FROM embeddings) GROUP BY 1""")
def null_gap_distribution(t: Tables) -> DataFrame:
    return aggregate.row_gap_histogram(gappy_vectors(t), "vector")


@query("""SELECT (i - 1)::INTEGER AS idx, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS mean FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)
WHERE (vec_id * 7 + (i - 1) * 13) % 11 <> 0 GROUP BY 1""")
def mean_by_position(t: Tables) -> DataFrame:
    """Mean of each position over all vectors, gaps ignored."""
    long = gappy_vectors(t).select(F.posexplode("vector").alias("idx", "value"))
    return long.groupBy("idx").agg(F.count("value").alias("n"), (F.round(F.avg("value"), 6) + 0.0).alias("mean"))


@query("""SELECT vec_id, round(list_avg(v), 6) + 0.0 AS mean, round(list_stddev_pop(v), 6) AS sd FROM (
  SELECT vec_id, list_filter(list_transform(range(1, 65), lambda i: CASE WHEN (vec_id * 7 + (i - 1) * 13) % 11 <> 0 THEN embedding[i]::DOUBLE END), lambda x: x IS NOT NULL) AS v FROM embeddings)""")
def row_moments(t: Tables) -> DataFrame:
    """Mean and deviation of each vector, gaps ignored."""
    kept = gappy_vectors(t).select("vec_id", F.filter("vector", lambda x: x.isNotNull()).alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    with_mean = kept.select("vec_id", "v", mean.alias("m"))
    var = F.aggregate(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / n
    return with_mean.select("vec_id", (F.round("m", 6) + 0.0).alias("mean"), F.round(F.sqrt(var), 6).alias("sd"))


@query("""SELECT p_partkey, round(coalesce(nullif(p_size % 7, 0), 0) + p_retailprice, 4) AS total FROM part""")
def columns_to_vector(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("a"), F.col("p_retailprice").alias("b"))
    v = reshape.columns_to_vector(rows, ["a", "b"])
    return v.select("p_partkey", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("WITH " + REPORT_SQL + """, f AS (SELECT dow, slot, count(*) AS n FROM report GROUP BY ALL)
SELECT d::INTEGER AS dow, (s * 30)::INTEGER AS slot, (d * 48 + s)::INTEGER AS idx, coalesce(n, 0) AS n
FROM (SELECT unnest(range(0, 7)) AS d) CROSS JOIN (SELECT unnest(range(0, 48)) AS s) LEFT JOIN f ON dow = d AND slot = s * 30""")
def time_spine_counts(t: Tables) -> DataFrame:
    counts = report(t).groupBy("dow", "slot").agg(F.count(F.lit(1)).alias("n"))
    return reshape.time_spine(t.spark, 30).join(counts, ["dow", "slot"], "left").select("dow", "slot", "idx", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
