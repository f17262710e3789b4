"""Runs a query on Spark and its SQL on DuckDB and compares columns, row counts and values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x) if x != int(x) else int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    rows = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    cur = (con or connect(sf_dir)).execute(sql)
    found = [d[0] for d in cur.description]
    if sorted(found) != names:
        return f"columns {names} and {sorted(found)}"
    order = [found.index(n) for n in names]
    other = Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())
    if rows != other:
        return f"{names}: {rows.total()} and {other.total()} rows; only in Spark {list((rows - other).items())[:3]}; only in DuckDB {list((other - rows).items())[:3]}"
    return "" if rows else "no rows"
