"""Holds a query's rows against its DuckDB SQL."""

import glob
import os

import duckdb


def _plain(v):
    if v is None or v != v:
        return "-"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def check(df, sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert got == expected
