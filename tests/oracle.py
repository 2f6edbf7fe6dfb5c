"""Compares a query with its SQL on the same Parquet files: column names, row count and values, in any order."""

from __future__ import annotations

import math
import os

import duckdb

from tilewright.runtime import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chromsizes intervals cnvs_hw basegffentity dm3_values benchmark".split()


def session():
    spark = local_session("tests", "8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(d: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows), sorted(columns)


def differences(df, con, sql: str) -> str:
    """Empty if equal."""
    a, ca = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    b, cb = rows_of(rel.columns, rel.fetchall())
    if ca != cb:
        return f"columns {ca} and {cb}"
    if a != b:
        from collections import Counter

        x, y = Counter(a), Counter(b)
        return f"{len(a)} and {len(b)} rows; only Spark {list((x - y).elements())[:4]}; only SQL {list((y - x).elements())[:4]}"
    return ""
