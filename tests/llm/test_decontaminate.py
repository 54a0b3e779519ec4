import random

import pytest

from sparkloom.llm import decontaminate
from tests.llm import brute


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [0, 200_000])
def test_equals_brute_force(spark, limit):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["A", "b", "é", "c1", "über", "Zz"])
    items = [(i, rnd.choice([" ", "-", ". "]).join(word() for _ in range(rnd.choice([0, 1, 3, 13, 14, 20])))) for i in range(12)] + [(90, None), (91, "...")]
    rows = []
    for i in range(60):
        parts = [rnd.choice(items)[1] or "" if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        rows.append((rnd.choice([i, i, None]), rnd.choice([" ".join(parts), " ".join(parts).lower(), None, "", "  "])))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.verdicts(docs, bench, broadcast_rows=limit)) == brute.contamination(rows, items)


def test_long_text_empty_tables_and_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " * 50_000 + item, "a", 1), (2, item, "b", 2)], "doc_id long, text string, w string, item_id int")
    bench = spark.createDataFrame([(5, item, 0)], "item_id long, text string, doc_id int")
    assert found(decontaminate.verdicts(docs, bench)) == [(1, 50_030, 30, ["5"], False), (2, 30, 30, ["5"], True)]
    assert decontaminate.verdicts(docs.limit(0), bench).count() == 0
    assert found(decontaminate.verdicts(docs, bench.limit(0))) == [(1, 50_030, 0, [], False), (2, 30, 0, [], False)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate.verdicts(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
