"""Spark rows against DuckDB rows, whatever their order."""

import glob
import os

import duckdb


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}") if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck_rows(sf, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(names)
    return order, sorted((tuple(norm(x[names.index(c)]) for c in order) for x in r.fetchall()), key=repr)


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
