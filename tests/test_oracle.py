"""Every registered query against DuckDB on the smallest data set."""

import importlib

import pytest

from sparkloom.plans.catalog import load
from tests.compare import check, connect
from tests.evidence import TESTED

FOLDER = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, con, name):
    ok, message, _, _ = check(spark, con, FOLDER, name, CATALOG[name])
    assert ok, message


def test_entry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 200


def test_queries_without_sql_have_a_test():
    assert set(TESTED) == {name for name, q in CATALOG.items() if q.oracle is None}
    for place in TESTED.values():
        module, test = place.split(".")
        assert callable(getattr(importlib.import_module(f"tests.{module}"), test))
