"""Sales cube: fact table of line items, customers in states, products in categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import joins
from sparkloom.operators.aggregate import max_of_sums, sales_by, top_entities
from sparkloom.plans.registry import Tables, query
from sparkloom.runtime import materialise

SALE_SQL = """sale AS (
  SELECT o_custkey AS customer_id, l_partkey AS product_id, l_quantity AS quantity,
         l_extendedprice / l_quantity AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
wide AS (
  SELECT s.*, c_name AS customer_name, n_name AS state_name, p_name AS product_name, p_type AS category
  FROM sale s JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN part ON product_id = p_partkey)
"""


def sale(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def customers(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("state_name"))


def products(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
                         F.col("p_type").alias("category"))


def wide(t: Tables) -> DataFrame:
    """Line-level star join; large keys shuffle, small dimensions are broadcast by size."""
    return sale(t).join(products(t), "product_id").join(customers(t), "customer_id")


def states(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("state_name"))


def categories(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_type").alias("category")).distinct()


def totals_by_customer(t: Tables) -> DataFrame:
    """Partial totals: one row per customer before any dimension is joined."""
    return sale(t).groupBy("customer_id").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("sales"))


@query("WITH " + SALE_SQL + """
SELECT customer_id, sum(quantity) AS total_items, round(sum(quantity * price), 2) AS total_sales
FROM sale GROUP BY customer_id""")
def sales_by_customer(t: Tables) -> DataFrame:
    return sales_by(sale(t), ["customer_id"], "total_items", "total_sales")


@query("WITH " + SALE_SQL + """
SELECT state_name, round(sum(quantity * price), 2) AS total_sales FROM wide GROUP BY state_name""")
def sales_by_state(t: Tables) -> DataFrame:
    """Pre-aggregated per customer, so the joins with the dimensions see few rows."""
    per_customer = totals_by_customer(t).join(customers(t), "customer_id")
    return per_customer.groupBy("state_name").agg(F.round(F.sum("sales"), 2).alias("total_sales"))


@query("WITH " + SALE_SQL + """
SELECT customer_id, customer_name, product_name, round(sum(quantity * price), 2) AS total_sales FROM wide
WHERE customer_name = 'Customer#000000001' GROUP BY customer_id, customer_name, product_name""")
def sales_by_product_for_customer(t: Tables) -> DataFrame:
    one = customers(t).filter(F.col("customer_name") == "Customer#000000001")
    rows = sale(t).join(one, "customer_id").join(products(t), "product_id")
    return (rows.groupBy("customer_id", "customer_name", "product_name")
            .agg(F.round(F.sum(F.col("quantity") * F.col("price")), 2).alias("total_sales"))
            .orderBy(F.desc("total_sales"), "product_name"))


@query("WITH " + SALE_SQL + """
SELECT customer_id, product_id, sum(quantity) AS total_items, round(sum(quantity * price), 2) AS total_sales
FROM sale GROUP BY customer_id, product_id""")
def sales_by_product_and_customer(t: Tables) -> DataFrame:
    """Combinations that occur; the full product of both keys is unbounded."""
    return sales_by(sale(t), ["customer_id", "product_id"], "total_items", "total_sales")


@query("WITH " + SALE_SQL + """, combos AS (
  SELECT category, n_name AS state_name FROM (SELECT DISTINCT p_type AS category FROM part), nation),
totals AS (SELECT category, state_name, round(sum(quantity * price), 2) AS sales_total FROM wide GROUP BY category, state_name)
SELECT c.category, c.state_name, coalesce(sales_total, 0.0) AS total_sales
FROM combos c LEFT JOIN totals t ON c.category = t.category AND c.state_name = t.state_name
ORDER BY sales_total DESC NULLS LAST""")
def sales_densified_category_state(t: Tables) -> DataFrame:
    totals = (wide(t).groupBy("category", "state_name")
              .agg(F.round(F.sum(F.col("quantity") * F.col("price")), 2).alias("total_sales")))
    full = joins.densify(categories(t), states(t), totals, ["category", "state_name"], {"total_sales": 0.0})
    return full.orderBy(F.desc_nulls_last("total_sales"), "category", "state_name")


@query("WITH " + SALE_SQL + """, combos AS (
  SELECT c_custkey AS customer_id, category FROM customer, (SELECT DISTINCT p_type AS category FROM part)),
totals AS (SELECT customer_id, category, round(sum(quantity * price), 2) AS total_sales FROM wide GROUP BY ALL)
SELECT c.customer_id, c.category, coalesce(total_sales, 0.0) AS total_sales
FROM combos c LEFT JOIN totals t ON c.customer_id = t.customer_id AND c.category = t.category""")
def sales_densified_category_customer(t: Tables) -> DataFrame:
    totals = (sale(t).join(products(t), "product_id").groupBy("customer_id", "category")
              .agg(F.round(F.sum(F.col("quantity") * F.col("price")), 2).alias("total_sales")))
    every = t.customer.select(F.col("c_custkey").alias("customer_id"))
    return joins.densify(every, categories(t), totals, ["customer_id", "category"], {"total_sales": 0.0})


def _top_sql(key: str) -> str:
    return "WITH " + SALE_SQL + f"""
SELECT {key}, sum(quantity) AS qty, round(sum(quantity * price), 2) AS sales
FROM wide GROUP BY {key} ORDER BY sales DESC, {key} LIMIT 20"""


@query(_top_sql("category"))
def top_categories(t: Tables) -> DataFrame:
    return top_entities(sale(t).join(products(t), "product_id"), "category", 20)


@query(_top_sql("customer_name"))
def top_customers(t: Tables) -> DataFrame:
    rows = totals_by_customer(t).join(customers(t), "customer_id").withColumn("price", F.lit(1.0))
    return (rows.groupBy("customer_name").agg(F.sum("quantity").alias("qty"), F.round(F.sum("sales"), 2).alias("sales"))
            .orderBy(F.desc("sales"), "customer_name").limit(20))


@query(_top_sql("state_name"))
def top_states(t: Tables) -> DataFrame:
    rows = totals_by_customer(t).join(customers(t), "customer_id")
    return (rows.groupBy("state_name").agg(F.sum("quantity").alias("qty"), F.round(F.sum("sales"), 2).alias("sales"))
            .orderBy(F.desc("sales"), "state_name").limit(20))


LEVEL_SQL = "WITH " + SALE_SQL + """, s1 AS (
  SELECT category, state_name, customer_name, product_name, sum(quantity) AS quantity,
         round(sum(quantity * price), 2) AS sales
  FROM wide GROUP BY ALL),
m AS (SELECT category, state_name, max(quantity) AS max_qty, max(sales) AS max_sales FROM s1 GROUP BY ALL)
"""


def named_totals(t: Tables) -> DataFrame:
    """Totals per customer and product with their names: lines are summed by two ids before any string is joined."""
    sums = sale(t).groupBy("customer_id", "product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("sales"))
    return sums.join(products(t), "product_id").join(customers(t), "customer_id")


def level_one(t: Tables) -> DataFrame:
    return named_totals(t).groupBy("category", "state_name", "customer_name", "product_name").agg(
        F.sum("quantity").alias("quantity"), F.round(F.sum("sales"), 2).alias("sales"))


@query(LEVEL_SQL + "SELECT * FROM m")
def max_of_summed_sales(t: Tables) -> DataFrame:
    out = max_of_sums(named_totals(t), ["category", "state_name"], ["customer_name", "product_name"],
                      {"quantity": "max_qty", "sales": "max_sales"})
    return out.withColumn("max_sales", F.round("max_sales", 2))


@query(LEVEL_SQL + """, hit AS (SELECT s1.* FROM s1 JOIN m ON s1.category = m.category AND s1.state_name = m.state_name
  AND s1.quantity = m.max_qty AND s1.sales = m.max_sales)
SELECT g.category, hit.state_name AS state, customer_name AS customer, product_name AS product, quantity, sales
FROM (SELECT DISTINCT p_type AS category, n_name AS state_name FROM part, nation) g
LEFT JOIN hit ON hit.category = g.category AND hit.state_name = g.state_name""")
def cross_top_report(t: Tables) -> DataFrame:
    """Per category and state the row holding both maxima, NULLs where none does.

    A row of that kind is the largest ``(quantity, sales)`` pair of its group, so
    the candidates come from one aggregate; ties are then picked up by a join.
    """
    s1 = materialise(level_one(t), "level-one")
    best = (s1.groupBy("category", "state_name")
            .agg(F.max(F.struct("quantity", "sales")).alias("top"), F.max("sales").alias("max_sales"))
            .filter(F.col("top.sales") == F.col("max_sales"))
            .select("category", "state_name", "top.quantity", "top.sales"))
    hit = s1.join(best, ["category", "state_name", "quantity", "sales"], "left_semi").select(
        "category", "state_name", F.col("state_name").alias("state"), F.col("customer_name").alias("customer"),
        F.col("product_name").alias("product"), "quantity", "sales")
    return (joins.cartesian(categories(t), states(t)).join(hit, ["category", "state_name"], "left")
            .drop("state_name"))


@query(LEVEL_SQL + """SELECT category, state_name, customer_name, product_name, quantity, sales FROM (
  SELECT s1.*, row_number() OVER (PARTITION BY category, state_name
                                  ORDER BY sales DESC, quantity DESC, customer_name DESC, product_name DESC) AS rn
  FROM s1) WHERE rn = 1""")
def cross_top_by_sales(t: Tables) -> DataFrame:
    """Best row by sales in each category and state, by partial aggregation."""
    return (level_one(t).groupBy("category", "state_name")
            .agg(F.max(F.struct("sales", "quantity", "customer_name", "product_name")).alias("m"))
            .select("category", "state_name", "m.customer_name", "m.product_name", "m.quantity", "m.sales"))


@query("WITH " + SALE_SQL + """SELECT coalesce(category, 'ALL') AS category, coalesce(state_name, 'ALL') AS state_name,
  sum(quantity) AS quantity, round(sum(quantity * price), 2) AS sales FROM wide GROUP BY CUBE (category, state_name)""")
def sales_cube(t: Tables) -> DataFrame:
    """Grouped once at the finest level; the cube runs over those few rows."""
    base = wide(t).groupBy("category", "state_name").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("sales"))
    return (base.cube("category", "state_name")
            .agg(F.sum("quantity").alias("quantity"), F.round(F.sum("sales"), 2).alias("sales"))
            .select(F.coalesce("category", F.lit("ALL")).alias("category"),
                    F.coalesce("state_name", F.lit("ALL")).alias("state_name"), "quantity", "sales"))


@query("WITH " + SALE_SQL + """SELECT category, state_name, customer_name, product_name, quantity,
  round(quantity * price, 2) AS amount FROM wide""")
def star_join_sales(t: Tables) -> DataFrame:
    fact = sale(t).select(F.col("customer_id").alias("fc"), F.col("product_id").alias("fp"), "quantity", "price")
    out = joins.star_join(fact, [(products(t), "fp", "product_id"), (customers(t), "fc", "customer_id")])
    return out.select("category", "state_name", "customer_name", "product_name", "quantity",
                      F.round(F.col("quantity") * F.col("price"), 2).alias("amount"))
