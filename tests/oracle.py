"""Compares a query with its SQL on DuckDB, regardless of the order of rows."""

import datetime
import decimal
import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def compare(spark, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, SF)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in cur.fetchall()), key=repr)
    assert mine == theirs
