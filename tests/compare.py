"""Compare a Spark query with its SQL over the same tables."""

from __future__ import annotations

import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    """Whole floats as integers, decimals as floats, so that only values count."""
    if isinstance(v, Decimal):
        v = float(v)
    return int(v) if isinstance(v, float) and v.is_integer() else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return [c for c in got.columns], got.fetchall()


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty when both give the same rows."""
    df = query(spark, sf_dir)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    columns, rows = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    theirs = bag(columns, rows)
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark: {list((mine - theirs).items())[:3]}; only SQL: {list((theirs - mine).items())[:3]}"
