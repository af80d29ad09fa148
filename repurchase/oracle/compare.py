"""Run a registered query on Spark and its SQL on DuckDB, and compare.

Mirrors the driver's gate: same row count, same column names, same
multiset of rows (columns taken in name order, floats compared exactly).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from dataclasses import dataclass

import duckdb

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool):
        return (2, float(v)) if isinstance(v, decimal.Decimal) and v != int(v) else (2, int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (3, "nan")
        return (2, int(v)) if v.is_integer() else (2, v)
    if isinstance(v, dt.datetime):
        return (4, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (4, dt.datetime(v.year, v.month, v.day).isoformat())
    return (5, str(v))


@dataclass
class Result:
    name: str
    ok: bool
    detail: str
    spark_rows: int
    oracle_rows: int


def compare(name: str, spark_df, sql: str, con) -> Result:
    s_cols = spark_df.columns
    rows = spark_df.collect()
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    if sorted(s_cols) != sorted(o_cols):
        return Result(name, False, f"columns differ: spark={sorted(s_cols)} oracle={sorted(o_cols)}", len(rows), len(o_rows))
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    oi = [o_cols.index(c) for c in order]
    a = sorted(tuple(_norm(r[i]) for i in si) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in oi) for r in o_rows)
    if len(a) != len(b):
        return Result(name, False, f"row count spark={len(a)} oracle={len(b)}", len(a), len(b))
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return Result(name, False, f"values differ (first): {diffs} cols={order}", len(a), len(b))
    return Result(name, True, "", len(a), len(b))
