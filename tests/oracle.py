"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = os.environ.get("TRILOOM_TESTDATA", "/root/testdata/sf0.001")


def connection(path: str = TESTDATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{path}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return "null" if v is None else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(spark, con, query, sql, path: str = TESTDATA):
    df = query(spark, path)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
