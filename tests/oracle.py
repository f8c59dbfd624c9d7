"""Rows of a query and of its SQL, in one comparable form."""

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert len(a) == len(b)
    assert a == b
