"""Run every registered query in Spark and its SQL twin in DuckDB and compare the rows.

usage: python tools/check_oracles.py [sf folder] [query name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return a == b or abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    return a == b


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=sort_key)


def compare(spark_cols, spark_rows, duck_cols, duck_rows):
    a_cols, a = rows_of(spark_cols, spark_rows)
    b_cols, b = rows_of(duck_cols, duck_rows)
    if a_cols != b_cols:
        return f"columns differ: {a_cols} / {b_cols}"
    if len(a) != len(b):
        return f"row counts differ: {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    inexact = sum(x != y for x, y in zip(a, b))
    return f"ok ({inexact} rows equal only within 1e-9)" if inexact else "ok"


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def main():
    from quorate.plans.catalog import load_all
    from quorate.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = load_all()
    names = sys.argv[2:] or list(queries)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in oracles:
                result = "no SQL twin"
            else:
                cur = con.execute(oracles[name])
                result = compare(df.columns, rows, [d[0] for d in cur.description], cur.fetchall())
        except Exception as e:
            took, rows = time.time() - start, []
            result = f"{type(e).__name__}: {str(e)[:600]}"
        if not (result.startswith("ok") or result == "no SQL twin"):
            failed.append(name)
        print(f"{name:28s} {len(rows):8d} rows {took:6.2f}s  {result}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
