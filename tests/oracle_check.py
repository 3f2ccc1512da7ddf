"""Compares a Spark result with DuckDB on the same Parquet files, order-insensitively."""

import glob
import math
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6g}" if isinstance(value, (int, float)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


def same(df, sql, sf_dir):
    want = views(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
