"""Run registered queries against DuckDB on the same parquet files.

python -m tests.compare [--sf 0.01] [--show] [name-fragment ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time
from collections import Counter

import duckdb

from sparkloom.plans.catalog import load
from sparkloom.plans.registry import TABLES, Tables
from tests.evidence import TESTED


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, int, bool)) else repr(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def check(spark, con, folder, name, q):
    """Return (ok, message, spark rows, seconds)."""
    start = time.time()
    df = q.run(Tables(spark, folder))
    types = dict(df.dtypes)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if q.oracle is None:
        return bool(rows) and name in TESTED, f"{len(rows)} rows, no SQL; tested by {TESTED.get(name, 'nothing')}", rows, took
    cur = con.execute(q.oracle)
    cols = [d[0] for d in cur.description]
    otypes = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", rows, took
    odd = {c: (types[c], otypes[c]) for c in cols if TYPES.get(types[c], types[c]) != otypes[c].upper()}
    a, b = bag(df.columns, rows), bag(cols, want)
    note = f" types {odd}" if odd else ""
    if a == b:
        return not odd, f"{len(rows)} rows equal{note}", rows, took
    only_a, only_b = a - b, b - a
    return False, (f"{len(rows)} vs {len(want)} rows; {sum(only_a.values())} only spark, "
                   f"{sum(only_b.values())} only sql; cols {sorted(cols)}\n   spark {sorted(only_a, key=str)[:3]}\n   sql   {sorted(only_b, key=str)[:3]}{note}"), rows, took


def main():
    from sparkloom.session import get_spark

    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--show", action="store_true")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = get_spark(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g"})
    con = connect(folder)
    bad = []
    for name, q in load().items():
        module = q.run.__module__.split(".")[-1]
        if a.names and not any(n == module or n in name for n in a.names):
            continue
        try:
            ok, msg, rows, took = check(spark, con, folder, name, q)
        except Exception as e:  # noqa: BLE001
            ok, msg, rows, took = False, f"{type(e).__name__}: {str(e)[:700]}", [], 0
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.1f}s {name}: {msg}", flush=True)
        if a.show:
            for r in rows[:3]:
                print("     ", str(r)[:300])
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
