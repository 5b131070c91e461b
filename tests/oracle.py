"""Comparison of a query with its reference SQL."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(con, sql):
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())
