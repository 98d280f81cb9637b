"""Comparison of a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(x):
    if x is None or x is pd.NaT:
        return "null"
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, text):
    got = con.execute(text)
    names = [c[0] for c in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall()), sorted(names)
