"""Rows of a Spark result and of a SQL result as comparable multisets."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()), cols


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return Counter(tuple(plain(row[i]) for i in at) for row in rel.fetchall()), cols
