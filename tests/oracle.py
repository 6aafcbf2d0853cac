"""Runs a registered query and its SQL on the same files and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return str(value)


def same(a, b, tol):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k], tol) for k in a)
    return a == b


def key(row):
    return tuple(repr(v) if not isinstance(v, float) else f"{v:.4f}" for v in row)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, query, sql, sf_dir, tol=0.0):
    start = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"{name}: {len(ours)} rows in {took:.1f}s (no SQL)", len(ours) > 0
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    duck = time.time() - start - took
    if sorted(theirs_names) != columns:
        return f"{name}: columns differ {columns} {sorted(theirs_names)}", False
    order = [theirs_names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in rows]
    if len(ours) != len(theirs):
        return f"{name}: {len(ours)} rows against {len(theirs)}", False
    ours.sort(key=key)
    theirs.sort(key=key)
    wrong = [(a, b) for a, b in zip(ours, theirs) if not all(same(x, y, tol) for x, y in zip(a, b))]
    if wrong:
        a, b = wrong[0]
        diff = [(c, x, y) for c, x, y in zip(columns, a, b) if not same(x, y, tol)]
        return f"{name}: {len(wrong)} of {len(ours)} rows differ, e.g. {str(diff)[:600]}", False
    return f"{name}: {len(ours)} rows equal, spark {took:.1f}s sql {duck:.1f}s", True


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallyrisk.session import local_session

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            text, ok = compare(spark, con, name, query, sqls.get(name), sf)
        except Exception as e:  # report and go on
            text, ok = f"{name}: {type(e).__name__} {str(e)[:1500]}", False
        bad += not ok
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print("failures:", bad)
