"""Compares a query with its SQL over the same tables."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return str(x.date())
    return str(x) if isinstance(x, datetime.date | datetime.datetime) else repr(x) if isinstance(x, list | dict | tuple) else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
