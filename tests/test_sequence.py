"""Skew-safe LEAD against a direct per-group computation."""

import random

import pytest
from pyspark.sql import functions as F

from repurchase.plans.sequence import next_in_group


def expected(rows):
    by = {}
    for k, t, i in rows:
        by.setdefault(k, []).append((t, i))
    out = {}
    for k, lst in by.items():
        lst.sort(key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1]))
        for a, b in zip(lst, lst[1:] + [None]):
            out[a[1]] = b
    return out


def frame(spark, rnd, wide=50):
    rows = []
    for k in range(30):
        for _ in range(400 if k == 5 else rnd.randint(1, 6)):  # key 5 holds most rows
            rows.append((k, None if rnd.random() < 0.05 else rnd.randint(0, wide), len(rows)))
    return rows, spark.createDataFrame(rows, "k long, t long, i long")


def check(rows, out):
    want = expected(rows)
    assert len(out) == len(rows)
    for r in out:
        w = want[r.i]
        assert r._has_next == (w is not None)
        assert (r.next_t, r.next_i) == (w or (None, None))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_hot_group_split_across_buckets(spark, width):
    rows, df = frame(spark, random.Random(3))
    check(rows, next_in_group(df, ["k"], ["t", "i"], ["t", "i"], F.floor(F.col("t") / width)).collect())


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_columns_that_are_neither_keys_nor_carried_are_kept(spark, reuse):
    """Also without exchange reuse: buckets are expressions of the row."""
    rows, df = frame(spark, random.Random(4), 5000)
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        wide = df.withColumn("more", F.col("i") * 3).repartition(13)
        out = next_in_group(wide, ["k"], ["t", "i"], ["t", "i"], F.floor(F.col("t") / 100)).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    check(rows, out)
    assert all(r.more == 3 * r.i for r in out)


def test_null_keys_and_default_buckets(spark):
    rows = [(None, 1, 1), (None, 2, 2), (1, 5, 3), (1, None, 4), (1, 3, 5), (1, 9000, 6)]
    df = spark.createDataFrame(rows, "k long, t long, i long")
    got = {r.i: (r.next_t, r.next_i) for r in next_in_group(df, ["k"], ["t", "i"], ["t", "i"]).collect()}
    assert got == {1: (2, 2), 2: (None, None), 5: (5, 3), 3: (9000, 6), 6: (None, 4), 4: (None, None)}


def test_day_buckets_of_times(spark):
    rows = [(1, f"2020-01-0{d} 0{h}:00:00", 10 * d + h) for d in (1, 2, 5) for h in (1, 2)]
    df = spark.createDataFrame(rows, "k long, t string, i long").selectExpr("k", "CAST(t AS TIMESTAMP_NTZ) t", "i")
    got = {r.i: r.next_i for r in next_in_group(df, ["k"], ["t", "i"], ["i"]).collect()}
    assert got == {11: 12, 12: 21, 21: 22, 22: 51, 51: 52, 52: None}
