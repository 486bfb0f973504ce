"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("RISKFRAME_TESTDATA", "/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r.asDict(True)[c] for c in df.columns) for r in df.collect()])
    con = duck(sf_dir)
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows"
    extra = [r for r in got[1] if r not in set(want[1])][:3] if got[0] == want[0] else []
    missing = [r for r in want[1] if r not in set(got[1])][:3] if got[0] == want[0] else []
    return False, f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; extra {extra}; missing {missing}"
