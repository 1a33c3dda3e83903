"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(str, r)))


def connect(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{t}')")
    return c


def assert_same(spark, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cursor = connect(sf_dir).execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
