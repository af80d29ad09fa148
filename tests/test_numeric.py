"""Exact rounding helpers against Python's Decimal and the oracle's SQL."""

from decimal import ROUND_HALF_UP, Decimal

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repurchase.functions import pct, round_double, round_ratio, round_ratio_int
from repurchase.oracle import sql as osql


def exact(n: int, d: int, dp: int) -> float:
    q = (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-dp), rounding=ROUND_HALF_UP)
    return float(q)


PAIRS = [(0, 1), (1, 3), (2, 3), (1, 8), (5, 8), (-5, 8), (5, -8), (1005, 1000), (123456789, 7), (7, 0), (3, 400)]


def test_round_ratio_matches_decimal(spark):
    df = spark.createDataFrame(PAIRS, "n long, d long")
    rows = df.select("n", "d", *[round_ratio("n", "d", dp).alias(f"r{dp}") for dp in (0, 1, 2, 4)]).collect()
    for r in rows:
        for dp in (0, 1, 2, 4):
            got = r[f"r{dp}"]
            if r.d == 0:
                assert got is None
            else:
                assert got == exact(r.n, r.d, dp), (r.n, r.d, dp, got)


def test_column_and_text_paths_agree(spark):
    df = spark.createDataFrame(PAIRS, "n long, d long")
    a = df.select(round_ratio_int("n", "d", 2).alias("x")).collect()
    b = df.select(round_ratio_int(F.col("n"), F.col("d"), 2).alias("x")).collect()
    assert a == b


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_pct_matches_duckdb_rule(spark_session_cache, pairs):
    spark = spark_session_cache
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(pct("n", "d", 2)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(n BIGINT, d BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    want = [r[0] for r in con.execute(f"SELECT {osql.pct('n', 'd', 2)} FROM t").fetchall()]
    assert got == want
    assert got == [exact(100 * n, d, 2) for n, d in pairs]


def test_round_double_half_away(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (1.0049999,), (None,)], "x double")
    got = [r[0] for r in df.select(round_double("x", 2)).collect()]
    assert got[:4] == [2.5, -2.5, 0.13, 1.0]
    assert got[4] is None
