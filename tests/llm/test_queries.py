"""Every query of the subpackage on the smallest data, against its SQL form where it has one."""

import os

import pytest

from sparkloom.llm.queries import ORACLES, QUERIES
from tests.compare import TYPES, bag, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    table = {"op2": "conversations", "op3": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    if name not in ORACLES:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
        return
    cur = connect(FOLDER).execute(ORACLES[name])
    columns, kinds = [d[0] for d in cur.description], {d[0]: str(d[1]) for d in cur.description}
    assert bag(df.columns, rows) == bag(columns, cur.fetchall())
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds


def test_entry_registers_them():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "corpus_pipeline.py"))
