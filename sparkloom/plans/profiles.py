"""Profiling, cleaning, frequency tables and comparisons on the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import arrays
from sparkloom.operators import aggregate, joins, reshape, select, sequence, setops
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import text
from sparkloom.runtime import few_values

# ---- filters and cleaning ---------------------------------------------------


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey HAVING count(*) > 5")
def groups_over(t: Tables) -> DataFrame:
    return select.groups_over(t.orders, F.col("o_totalprice") > 200000, "o_custkey", 5)


@query("SELECT count(*) AS n FROM part WHERE p_name LIKE '%ring%'")
def count_like(t: Tables) -> DataFrame:
    return select.count_like(t.part, "p_name", "%ring%")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def above_average(t: Tables) -> DataFrame:
    return select.above_average(t.part.select("p_partkey", "p_retailprice"), "p_retailprice")


GAPPY_SQL = """gappy AS (SELECT p_partkey, nullif(p_size % 7, 0) AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price,
  CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS kind FROM part)
"""


def gappy(t: Tables) -> DataFrame:
    """Parts with NULLs put in by arithmetic."""
    k = F.col("p_partkey")
    return t.part.select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("size"),
                         F.when(k % 5 != 0, F.col("p_retailprice")).alias("price"),
                         F.when(k % 3 != 0, F.col("p_brand")).alias("brand"), F.when(k % 4 == 0, F.col("p_type")).alias("kind"))


@query("WITH " + GAPPY_SQL + """SELECT p_partkey FROM gappy WHERE size IS NOT NULL AND
  (price IS NULL)::INT + (brand IS NULL)::INT + (kind IS NULL)::INT <= 1""")
def drop_sparse_rows(t: Tables) -> DataFrame:
    return select.drop_sparse_rows(gappy(t), "size", 1).select("p_partkey")


@query("WITH " + GAPPY_SQL + "SELECT p_partkey, size, price, brand FROM gappy")
def drop_sparse_columns(t: Tables) -> DataFrame:
    return select.drop_sparse_columns(gappy(t), 0.5)


AMOUNT_SQL = "amounts AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * l_quantity, 2) AS amount FROM lineitem)"


def amounts(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("amount"))


def tukey_fences(df: DataFrame, column: str) -> tuple[float, float]:
    """Quartiles moved out by one and a half interquartile ranges; two numbers."""
    q = {r["share"]: r["value"] for r in sequence.exact_quantiles(df, column, [0.25, 0.75]).collect()}
    spread = q[0.75] - q[0.25]
    return q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread


@query("WITH " + AMOUNT_SQL + """, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM amounts)
SELECT l_orderkey, l_linenumber, l_partkey, amount FROM amounts, q WHERE amount > 0 AND amount <= b + 1.5 * (b - a)""")
def drop_outliers_iqr(t: Tables) -> DataFrame:
    rows = amounts(t)
    _, upper = tukey_fences(rows, "amount")
    return rows.filter((F.col("amount") > 0) & (F.col("amount") <= upper))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_quantity > 45 AND l_discount / 0.1 < 0.2)")
def drop_rule_outliers(t: Tables) -> DataFrame:
    odd = (F.col("l_quantity") > 45) & (F.col("l_discount") / 0.1 < 0.2)
    return t.lineitem.filter(~odd).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS nation FROM customer""")
def null_sentinels(t: Tables) -> DataFrame:
    raw = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 6 == 0, " . ").otherwise(F.col("c_mktsegment")).alias("seg"),
                            F.when(F.col("c_nationkey") == 3, -1).otherwise(F.col("c_nationkey")).alias("nat"))
    return raw.select("c_custkey", select.null_sentinel(F.col("c_acctbal"), F.col("c_acctbal") < 0).alias("balance"),
                      select.null_sentinel(F.col("seg"), F.trim("seg").isin("", ".")).alias("segment"),
                      select.null_sentinel(F.col("nat"), F.col("nat") == -1).alias("nation"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, lpad((o_custkey % 100)::VARCHAR, 2, '0') ||
  lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS code FROM orders""")
def coerce_types(t: Tables) -> DataFrame:
    """Dirty text to numbers, codes padded again and joined."""
    raw = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string")).alias("p"),
                          (F.col("o_custkey") % 100).cast("string").alias("a"), (F.col("o_orderkey") % 1000).cast("string").alias("b"))
    return raw.select("o_orderkey", F.col("p").try_cast("double").alias("price"), F.concat(F.lpad("a", 2, "0"), F.lpad("b", 3, "0")).alias("code"))


@query("""SELECT c_custkey, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT c_custkey, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS h FROM customer)""")
def tag_split(t: Tables) -> DataFrame:
    h = select.hash_share(F.col("c_custkey"))
    base = t.customer.select("c_custkey")
    return select.tag_split({"train": base.filter(h < 0.6), "validation": base.filter((h >= 0.6) & (h < 0.8)), "test": base.filter(h >= 0.8)})


@query("SELECT p_partkey AS partkey, p_size AS size FROM part")
def select_by_name(t: Tables) -> DataFrame:
    chosen = select.columns_matching(t.part, prefix="p_", drop=["p_name", "p_brand", "p_type", "p_retailprice"])
    return select.select_by_name(t.part.select(*chosen), prefix="p_", rename=lambda c: c[2:])


# ---- frequency and aggregates -----------------------------------------------

@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t: Tables) -> DataFrame:
    return setops.distinct_rows(t.part, "p_brand", "p_type")


@query("SELECT count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderdate) AS n_o_orderdate FROM orders")
def distinct_count(t: Tables) -> DataFrame:
    return aggregate.distinct_count(t.orders, "o_custkey", "o_orderdate")


@query()
def approximate_distinct(t: Tables) -> DataFrame:
    return aggregate.approximate_distinct(t.orders, "o_custkey", "o_orderdate")


@query("SELECT p_name, n, round(n / (SELECT count(*) FROM part), 6) AS share FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_name LIMIT 15")
def value_counts(t: Tables) -> DataFrame:
    return aggregate.value_counts(t.part, "p_name", 15).withColumn("share", F.round("share", 6))


@query("SELECT l_shipmode, total FROM (SELECT l_returnflag AS l_shipmode, sum(l_quantity) AS total FROM lineitem GROUP BY 1)")
def sum_by_key_sorted(t: Tables) -> DataFrame:
    """Records as delimited text: the last field is the key, the first the amount."""
    lines = t.lineitem.select(F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_linestatus"), F.col("l_returnflag")).alias("line"))
    key, fields = arrays.csv_to_kv(F.col("line"))
    kv = lines.select(key.alias("l_shipmode"), F.element_at(fields, 1).try_cast("double").alias("amount"))
    return aggregate.sum_by_key(kv, "l_shipmode", "amount")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def avg_by_key(t: Tables) -> DataFrame:
    return aggregate.avg_by_key(t.orders, "o_orderpriority", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("WITH " + GAPPY_SQL + """SELECT 'size' AS column, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS sd, min(size)::DOUBLE AS min,
 max(size)::DOUBLE AS max, count(*) - count(size) AS missing FROM gappy UNION ALL SELECT 'price', round(avg(price), 6), round(stddev_samp(price), 6),
 min(price), max(price), count(*) - count(price) FROM gappy""")
def profile_numeric(t: Tables) -> DataFrame:
    out = aggregate.profile_numeric(gappy(t), ["size", "price"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("WITH " + GAPPY_SQL + """, l AS (SELECT 'brand' AS "column", brand AS value FROM gappy UNION ALL SELECT 'kind', kind FROM gappy),
c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL),
f AS (SELECT "column", count(DISTINCT value) AS n_distinct, count(*) - count(value) AS missing FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS a, row_number() OVER (PARTITION BY "column" ORDER BY n, value)::INTEGER AS b FROM c)
SELECT "column", value, n, a AS rank, 'most' AS kind, n_distinct, missing FROM r JOIN f USING ("column") WHERE a <= 3
UNION ALL SELECT "column", value, n, b, 'least', n_distinct, missing FROM r JOIN f USING ("column") WHERE b <= 3""")
def profile_text(t: Tables) -> DataFrame:
    return aggregate.profile_text(gappy(t), ["brand", "kind"], 3)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def find_duplicates(t: Tables) -> DataFrame:
    return aggregate.find_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


VOTE_SQL = """votes AS (SELECT l_orderkey, l_partkey, (l_quantity::BIGINT % 4) AS total, least(l_quantity::BIGINT % 4, l_linenumber % 3) AS helpful FROM lineitem)
"""


def votes(t: Tables) -> DataFrame:
    total = F.col("l_quantity").cast("bigint") % 4
    return t.lineitem.select("l_orderkey", "l_partkey", total.alias("total"), F.least(total, (F.col("l_linenumber") % 3).cast("bigint")).alias("helpful"))


@query("WITH " + VOTE_SQL + """SELECT l_orderkey, round(coalesce(sum(helpful) / nullif(sum(total), 0), (SELECT sum(helpful) / sum(total) FROM votes)), 6) AS rate
FROM votes GROUP BY l_orderkey""")
def helpful_rate_by_user(t: Tables) -> DataFrame:
    return aggregate.entity_rate(votes(t), "l_orderkey", "helpful", "total").withColumn("rate", F.round("rate", 6))


@query("WITH " + VOTE_SQL + """, r AS (SELECT l_partkey, sum(helpful) / nullif(sum(total), 0) AS rate FROM votes GROUP BY 1)
SELECT p_partkey AS l_partkey, round(coalesce(rate, (SELECT sum(helpful) / sum(total) FROM votes)), 6) AS rate
FROM part LEFT JOIN r ON l_partkey = p_partkey""")
def helpful_rate_by_item(t: Tables) -> DataFrame:
    """Items never seen in training take the global rate."""
    seen = votes(t)
    overall = seen.agg(F.try_divide(F.sum("helpful"), F.sum("total"))).scalar()
    rates = aggregate.entity_rate(seen, "l_partkey", "helpful", "total")
    items = t.part.select(F.col("p_partkey").alias("l_partkey"))
    return aggregate.attach_rate(items, rates, "l_partkey", overall).withColumn("rate", F.round("rate", 6))


@query("WITH " + VOTE_SQL + """SELECT l_partkey, count(*) AS n_total, count(*) FILTER (WHERE total > 0) AS n_rated,
  round(count(*) FILTER (WHERE total > 0) / count(*), 6) AS rated_share FROM votes GROUP BY 1""")
def review_counts(t: Tables) -> DataFrame:
    return aggregate.review_counts(votes(t), "l_partkey", F.col("total") > 0).withColumn("rated_share", F.round("rated_share", 6))


@query("WITH " + GAPPY_SQL + ", c AS (SELECT count(*) AS n, count(p_partkey) a, count(size) b, count(price) c, count(brand) d, count(kind) e FROM gappy) "
       + " UNION ALL ".join(f"SELECT '{n}' AS column, n - {x} AS nulls, n - {x} > 0 AS any_null FROM c" for n, x in
                            [("p_partkey", "a"), ("size", "b"), ("price", "c"), ("brand", "d"), ("kind", "e")]))
def null_report(t: Tables) -> DataFrame:
    return aggregate.null_report(gappy(t))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), 4) + 0.0 AS cov, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem"
                          for i, a in enumerate(_NUM) for b in _NUM[i:]))
def corr_cov_matrix(t: Tables) -> DataFrame:
    out = aggregate.pairwise(t.lineitem, _NUM)
    return out.select("x", "y", (F.round("cov", 4) + 0.0).alias("cov"), (F.round("corr", 6) + 0.0).alias("corr"))


@query("""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_disc(value, 0.001), 6) AS p001,
  round(quantile_disc(value, 0.01), 6) AS p01, round(quantile_disc(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.999), 6) AS p999 FROM events""")
def moments(t: Tables) -> DataFrame:
    """The percentiles are approximate beyond the accuracy of the sketch, exact below it."""
    out = aggregate.moments(t.events, "value", accuracy=1_000_000)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "p001", "p01", "p99", "p999")])


@query("""SELECT unnest([0.001, 0.01, 0.25, 0.5, 0.99]::DOUBLE[]) AS share, round(unnest(quantile_cont(value, [0.001, 0.01, 0.25, 0.5, 0.99])), 6) AS value FROM events""")
def tail_quantiles(t: Tables) -> DataFrame:
    return sequence.exact_quantiles(t.events, "value", [0.001, 0.01, 0.25, 0.5, 0.99]).withColumn("value", F.round("value", 6))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_c_acctbal FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def group_means(t: Tables) -> DataFrame:
    out = aggregate.group_means(t.customer.filter("c_acctbal > 0"), ["c_nationkey", "c_mktsegment"], ["c_acctbal"])
    return out.withColumn("avg_c_acctbal", F.round("avg_c_acctbal", 4))


@query("""SELECT quality, CASE WHEN sum(toxic) = 0 THEN 99999.0::DOUBLE ELSE round((count(*) - sum(toxic)) / sum(toxic), 1) END AS ratio,
  round((count(*) - sum(toxic)) / count(*), 3) AS pct_negative FROM labels GROUP BY quality""")
def negative_shares(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality").agg(aggregate.neg_pos_ratio(F.col("toxic")).alias("ratio"), aggregate.pct_negative(F.col("toxic")).alias("pct_negative"))


@query("""SELECT max(o_totalprice) AS largest, (SELECT string_agg(r_name, ' ' ORDER BY r_regionkey) FROM region) AS joined,
  (SELECT round(max(list_max(embedding::DOUBLE[])), 6) FROM embeddings) AS list_max, (SELECT round(sum(list_max(embedding::DOUBLE[])), 4) FROM embeddings) AS max_sum FROM orders""")
def global_reduce(t: Tables) -> DataFrame:
    """Maximum, ordered concatenation of a bounded dimension, maxima over lists."""
    names = t.region.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda s: s["r_name"]), " "))
    e = F.col("embedding").cast("array<double>")
    return t.orders.agg(F.max("o_totalprice").alias("largest")).select(
        "largest", names.scalar().alias("joined"),
        t.embeddings.agg(F.round(F.max(F.array_max(e)), 6)).scalar().alias("list_max"),
        t.embeddings.agg(F.round(arrays.array_max_sum(e), 4)).scalar().alias("max_sum"))


@query("""SELECT year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def yearly_extremes(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return aggregate.yearly_extremes(rows, "year", "o_totalprice").withColumn("mean", F.round("mean", 4))


@query("""WITH y AS (SELECT year(o_orderdate)::INTEGER AS year, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY 1)
SELECT (SELECT year FROM y ORDER BY m, year LIMIT 1) AS key_of_min, (SELECT year FROM y ORDER BY m DESC, year LIMIT 1) AS key_of_max""")
def extreme_years(t: Tables) -> DataFrame:
    return aggregate.extreme_keys(yearly_extremes(t), "year", "mean")


@query("""SELECT year, n_open, n_done, n_total, round(n_open / n_total * 100, 4) AS pct_open, round(n_done / n_total * 100, 4) AS pct_done FROM (
  SELECT year(o_orderdate)::INTEGER AS year, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, count(*) AS n_total
  FROM orders GROUP BY 1)""")
def status_shares(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    counts = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_if(s == "O").alias("n_open"), F.count_if(s == "F").alias("n_done"), F.count(F.lit(1)).alias("n_total"))
    return counts.select("*", *[F.round(F.col(f"n_{c}") / F.col("n_total") * 100, 4).alias(f"pct_{c}") for c in ("open", "done")])


@query("""SELECT date, flow, n, max(n) OVER (PARTITION BY date) AS daily_max FROM (SELECT ts::DATE::VARCHAR AS date, event_type AS flow, count(*) AS n FROM events GROUP BY ALL)""")
def daily_flow_totals(t: Tables) -> DataFrame:
    """Daily totals side by side and stacked again, with the daily maximum."""
    counts = t.events.groupBy(F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("flow")).agg(F.count(F.lit(1)).alias("n"))
    flows = few_values(t.events, "event_type")
    side = aggregate.totals_by_flow(counts, "date", "flow", "n", flows)
    side = side.withColumn("daily_max", F.greatest(*flows))
    long = reshape.unpivot(side, ["date", "daily_max"], flows, "flow", "n")
    return long.filter("n > 0").select("date", "flow", "n", "daily_max")


# ---- joins --------------------------------------------------------------------

PRICE_SQL = "price AS (SELECT ts::DATE AS date, event_type AS ticker, round(avg(value), 6) AS price FROM events GROUP BY ALL)\n"


def prices(t: Tables) -> DataFrame:
    """Daily price of each ticker."""
    return t.events.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("ticker")).agg(F.round(F.avg("value"), 6).alias("price"))


_SERIES = ["click", "error", "purchase", "signup", "view"]


@query("WITH " + PRICE_SQL + "SELECT date::VARCHAR AS date, " + ", ".join(f"max(price) FILTER (ticker = '{k}') AS {k}" for k in _SERIES)
       + " FROM price GROUP BY date")
def align_series(t: Tables) -> DataFrame:
    """Daily prices of all five tickers side by side; a day that some lack has NULLs."""
    p = prices(t)
    return text(joins.align_by_key({k: p.where(F.col("ticker") == k) for k in _SERIES}, "date", "price"))


@query("""SELECT a.l_partkey, a.l_suppkey, q, coalesce(returned, 0) AS returned FROM
  (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) a LEFT JOIN
  (SELECT l_partkey, l_suppkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b USING (l_partkey, l_suppkey)""")
def merge_on_keys(t: Tables) -> DataFrame:
    """Two aggregates merged on two keys."""
    keys = ["l_partkey", "l_suppkey"]
    a = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("q"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
    return a.join(b, keys, "left").withColumn("returned", F.coalesce("returned", F.lit(0).cast("bigint")))


@query("""SELECT k AS custkey, a.n AS n_orders, b.n AS n_urgent FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a
  JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b USING (k)""")
def pair_join(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_urgent"))
    return a.join(b, "custkey")


@query("""SELECT p_partkey, coalesce(p.v, s.v, 0.0::DOUBLE) AS v FROM part
  LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1) p ON l_partkey = p_partkey
  LEFT JOIN (SELECT p_brand AS b, sum(p_size)::DOUBLE AS v FROM part GROUP BY 1) s ON b = p_brand""")
def lookup_with_fallback(t: Tables) -> DataFrame:
    fine = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("v"))
    coarse = t.part.groupBy("p_brand").agg(F.sum("p_size").cast("double").alias("v"))
    return joins.lookup_with_fallback(t.part.select("p_partkey", "p_brand"), fine, coarse, "p_partkey", "p_brand", "v", 0.0).select("p_partkey", "v")


@query("""WITH y AS (SELECT c_nationkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT sum(v) FILTER (WHERE y = 1997) / sum(v) FILTER (WHERE y = 1996) AS r FROM y)
SELECT c_nationkey, round(a.v, 2) AS value_0, round(b.v, 2) AS value_1, round(b.v / a.v, 6) AS ratio, round(b.v / a.v / r, 6) AS relative_ratio
FROM (SELECT * FROM y WHERE y = 1996) a JOIN (SELECT * FROM y WHERE y = 1997) b USING (c_nationkey), n""")
def compare_periods(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    out = joins.compare_periods(rows, "year", 1996, 1997, ["c_nationkey"], "o_totalprice", F.lit(True))
    return out.select("c_nationkey", *[F.round(c, 2).alias(c) for c in ("value_0", "value_1")],
                      *[F.round(c, 6).alias(c) for c in ("ratio", "relative_ratio")])


# ---- order ---------------------------------------------------------------------

@query("""(SELECT c_custkey, c_acctbal, 'low' AS side FROM customer WHERE c_nationkey <> 2 ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL
  (SELECT c_custkey, c_acctbal, 'high' FROM customer WHERE c_nationkey <> 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 5)""")
def extremes(t: Tables) -> DataFrame:
    rows = t.customer.filter("c_nationkey <> 2").select("c_custkey", "c_acctbal")
    low = rows.orderBy("c_acctbal", "c_custkey").limit(5).withColumn("side", F.lit("low"))
    high = rows.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).withColumn("side", F.lit("high"))
    return setops.union_all(low, high)


@query("""WITH t AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
SELECT c_custkey, round(c_acctbal - (SELECT min(c_acctbal) FROM t), 2) AS above_min, round(c_acctbal - (SELECT avg(c_acctbal) FROM t), 2) + 0.0 AS above_mean FROM t""")
def subtract_min_of_top(t: Tables) -> DataFrame:
    top = t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    low, mean = top.agg(F.min("c_acctbal")).scalar(), top.agg(F.avg("c_acctbal")).scalar()
    return top.select("c_custkey", F.round(F.col("c_acctbal") - low, 2).alias("above_min"), (F.round(F.col("c_acctbal") - mean, 2) + 0.0).alias("above_mean"))


@query("""SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type FROM part""")
def label_encode(t: Tables) -> DataFrame:
    return sequence.label_encode(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")


@query("""SELECT value, n, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 9) AS cdf FROM (SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1)""")
def empirical_cdf(t: Tables) -> DataFrame:
    return sequence.empirical_cdf(t.lineitem, "l_discount").withColumn("cdf", F.round("cdf", 9))


@query("""SELECT DISTINCT o_orderkey, round(cume_dist() OVER (ORDER BY o_totalprice), 9) AS cdf FROM orders""")
def order_price_cdf(t: Tables) -> DataFrame:
    cdf = sequence.empirical_cdf(t.orders, "o_totalprice").select(F.col("value").alias("o_totalprice"), "cdf")
    return t.orders.join(cdf, "o_totalprice").select("o_orderkey", F.round("cdf", 9).alias("cdf"))


@query("WITH " + PRICE_SQL + """SELECT date::VARCHAR AS date, ticker, price, round(ln(lead(price) OVER (PARTITION BY ticker ORDER BY date) / price), 6) + 0.0 AS diff FROM price""")
def log_diff(t: Tables) -> DataFrame:
    out = sequence.log_diff(prices(t), ["ticker"], "date", "price", F.trunc("date", "month"))
    return text(out.withColumn("diff", F.round("diff", 6) + 0.0))
