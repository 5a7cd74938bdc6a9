"""Comparing a Spark result with DuckDB's over the same tables."""

import glob
import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if type(v).__name__ == "Decimal":
        return str(v.normalize() + 0)
    return None if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v)


def connect(folder=FOLDER):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def check(df, sql, connection):
    cols = sorted(df.columns)
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=str)
    assert got == want
