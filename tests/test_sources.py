"""Readers and sinks on files made by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import readers, sinks


def test_one_file_per_key(spark, tmp_path):
    for key, price in (("AAA", 1.5), ("BBB", 2.5), ("CCC", 3.5)):
        (tmp_path / f"{key}.csv").write_text(f"date,price\n2024-01-01,{price}\n2024-01-02,bad\n")
    df = readers.scan_per_key_files(spark, str(tmp_path), "date string, price double", keep=["AAA", "BBB"], omit=["BBB"])
    assert [(r.key, r.price) for r in df.orderBy("date").collect()] == [("AAA", 1.5), ("AAA", None)]


def test_ragged_lines(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("a,b,c\n1,2,3\n1,2\n1,2,3,4\n")
    r = readers.validate_delimited(spark, str(f)).first()
    assert (r.n_lines, r.header_width, r.n_ragged) == (4, 3, 2)
    bad = readers.field_count_errors(readers.scan_text(spark, str(f)), 3)
    assert sorted(x.n_fields for x in bad.collect()) == [2, 4]


def test_gzipped_nested_records(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        for i in range(3):
            f.write(json.dumps({"id": i, "helpful": {"nHelpful": i, "outOf": 4}}) + "\n")
    df = readers.scan_gz_records(spark, str(tmp_path / "r.json.gz"), "id int, helpful struct<nHelpful: int, outOf: int>")
    assert df.agg(F.sum("helpful.nHelpful")).first()[0] == 3


def test_fixed_width(spark, tmp_path):
    f = tmp_path / "s.txt"
    f.write_text("USW01  32.5 CA\nUSW2      . NV\n")
    rows = readers.scan_fixed_width(spark, str(f), [("id", 0, 5), ("lat", 5, 11, "double"), ("state", 12, 14, "string", 4)]).collect()
    assert [tuple(r) for r in rows] == [("USW01", 32.5, "00CA"), ("USW2", None, "00NV")]


def test_triplets(spark, tmp_path):
    f = tmp_path / "t.data"
    f.write_text("1 10 2\n1 11 1\n2 10 5\n")
    assert readers.scan_triplets(spark, str(f)).agg(F.sum("count")).first()[0] == 8


def test_table_scan_prunes(spark, tables, tmp_path):
    sinks.write_table(tables.orders, "t_orders", str(tmp_path / "t"))
    df = readers.scan_table(spark, "t_orders", ["o_orderkey"], "o_custkey = 3")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,3)" in p and "o_totalprice" not in p
    spark.sql("DROP TABLE t_orders")


def test_bucketed_tables_join_without_shuffle(spark, tables, tmp_path):
    sinks.write_table(tables.orders, "b_orders", str(tmp_path / "o"), buckets=(4, "o_orderkey"))
    sinks.write_table(tables.lineitem, "b_lines", str(tmp_path / "l"), buckets=(4, "l_orderkey"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.table("b_orders").join(spark.table("b_lines"), F.col("o_orderkey") == F.col("l_orderkey"))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_orders")
        spark.sql("DROP TABLE b_lines")


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_document_in_parts(spark, tmp_path, n):
    feats = spark.range(n).select(F.struct(F.lit("Feature").alias("type"), F.col("id")).alias("feature"))
    path = tmp_path / "document"
    sinks.write_feature_collection(feats, str(path))
    whole = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    assert sorted(f["id"] for f in json.loads(whole)["features"]) == list(range(n))
