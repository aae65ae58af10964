"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted(tuple(_cell(r[i]) for i in order) for r in rows))


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return normal(names, rel.fetchall())


def difference(left, right):
    """A short account of how two normalised results differ, or an empty text."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return ""
    a, b = set(left[1]), set(right[1])
    return (f"rows {len(left[1])} != {len(right[1])}; only Spark {sorted(a - b)[:3]}; "
            f"only SQL {sorted(b - a)[:3]}")


def main(folder, names):
    import __spark_entry__ as entry
    from panelspark.session import build_session
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            took = time.time() - start
            start = time.time()
            note = difference(got, sql_rows(con, oracles[name])) if name in oracles else "no SQL"
            print(f"{name:32s} {len(got[1]):7d} rows {took:6.2f}s sql {time.time()-start:5.2f}s  "
                  f"{note or 'equal'}", flush=True)
            bad += bool(note) and note != "no SQL"
        except Exception as e:  # noqa: BLE001 - a report, not a handler
            bad += 1
            print(f"{name:32s} FAILED {str(e)[:700]}", flush=True)
    print("differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
