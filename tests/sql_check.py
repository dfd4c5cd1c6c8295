"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime as dt
import glob
import math
import os

DATA = "/root/testdata/sf0.001"


def connection():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, dt.datetime):
        return str(value.date())
    if isinstance(value, dt.date):
        return str(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio"):
        return float(value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(left, right):
    def equal(a, b):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-4) if isinstance(a, float) and isinstance(b, float) else a == b

    return len(left) == len(right) and all(equal(a, b) for x, y in zip(left, right) for a, b in zip(x, y))


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert same(got, want), (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:2])
