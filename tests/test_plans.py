"""Physical plans: pushdown, no row-wise Python, no products."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import textfn
from sparkloom.operators import select, sequence
from sparkloom.plans import profiles, sales, texts, traffic
from sparkloom.plans.catalog import load


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(tables):
    p = plan(select.within_dates(tables.events, "ts", "2024-01-05", "2024-01-09").select("event_id"))
    assert "GreaterThanOrEqual(ts" in p and "LessThan(ts" in p
    assert "props" not in p.split("ReadSchema")[1]


def test_small_dimensions_are_broadcast(tables):
    assert "BroadcastHashJoin" in plan(sales.sales_by_state(tables))


@pytest.mark.parametrize("fn", [texts.tokenize_documents, texts.text_shape, texts.readability, texts.top_kmers, texts.mentions_per_token])
def test_text_stays_in_the_jvm(tables, fn):
    p = plan(fn(tables))
    assert "EvalPython" not in p and "MapInArrow" not in p


def test_top_k_is_not_a_full_sort(tables):
    assert "TakeOrderedAndProject" in plan(sales.top_states(tables))


def test_group_limit_before_the_shuffle(tables):
    out = sequence.top_n_per_group(tables.orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    assert plan(out).count("WindowGroupLimit") == 2


def test_partial_aggregation(tables):
    assert plan(sales.sales_by_customer(tables)).count("HashAggregate") >= 2


def test_scalar_bound_is_not_a_join(tables):
    assert "Join" not in plan(profiles.above_average(tables))


CHEAP = [n for n, q in load().items() if q.run.__module__.rsplit(".", 1)[-1] in {"sales", "likes", "traffic", "profiles", "shapes", "evaluation", "texts"}]


@pytest.mark.parametrize("name", CHEAP)
def test_no_products(tables, name):
    p = plan(load()[name].run(tables))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p


def test_sampling_is_repeatable(tables):
    a = select.sample_by_key(tables.orders, "o_orderkey", 10)
    b = select.sample_by_key(tables.orders.repartition(5), "o_orderkey", 10)
    assert {r.o_orderkey for r in a.collect()} == {r.o_orderkey for r in b.collect()}


def test_tokens_are_cut_once(tables):
    """The token array is a column of its own before it is used per run."""
    p = plan(texts.top_kmers(tables))
    assert p.count("regexp_extract_all") <= 2
    assert textfn.WORD and traffic.BOX


@pytest.mark.parametrize("name, table", [
    ("ppmi", "documents"), ("context_counts", "documents"), ("relative_popularity", "documents"), ("weighted_recommend", "lineitem"), ("my_kind_likes", "lineitem"),
    ("cross_top_report", "lineitem"), ("max_of_summed_sales", "lineitem"), ("two_way_effects", "events"), ("alternating_effects", "events"), ("chi_square", "events"),
    ("special_event_flags", "events"), ("posts_by_group", "documents"), ("overlap_significance", "events")])
def test_each_table_is_read_once(tables, name, table):
    """What is left to run after the steps that were written reads the table at most once."""
    assert plan(load()[name].run(tables)).count(f"{table}.parquet]") <= 1
