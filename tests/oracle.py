"""Compare a query with its DuckDB oracle, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in found)


def check(spark, sf, name, query, sql, con=None):
    rel = (con or connect(sf)).sql(sql)
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(rel.columns), (name, df.columns, rel.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(ours) == len(theirs), (name, len(ours), len(theirs))
    bad = [(x, y) for x, y in zip(ours, theirs, strict=True) if x != y]
    assert not bad, (name, bad[:3])
    return len(ours)
