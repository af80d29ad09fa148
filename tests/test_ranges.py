"""Range bounds from the rows, and LEAD between them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repurchase.plans.ranges import bucket_of, range_bounds
from repurchase.plans.sequence import next_in_group

SQL_LEAD = "lead({c}) OVER (PARTITION BY k ORDER BY {o} ASC NULLS LAST, i ASC NULLS LAST)"


def sort_key(row):
    return [(v is None, 0 if v is None else v) for v in row]


@pytest.mark.parametrize(
    "kind, make",
    [
        ("long", lambda r: r.choice([-(2**63), 2**63 - 1, r.randrange(100), None])),
        ("string", lambda r: r.choice(["", "a", "b" * r.randrange(9), None, "é"])),
        ("date", lambda r: None if r.random() < 0.1 else __import__("datetime").date(2020, 1, 1 + r.randrange(28))),
        ("double", lambda r: r.random() * 1e300),
    ],
)
def test_buckets_never_fall_where_the_key_grows(spark, kind, make):
    r = random.Random(kind)
    df = spark.createDataFrame([(make(r), i) for i in range(500)], f"t {kind}, i long")
    bounds = range_bounds(df, ["t", "i"], parts=16, per_part=4)
    rows = df.select("*", bucket_of(df, ["t", "i"], bounds).alias("b")).collect()
    rows.sort(key=lambda x: sort_key((x.t, x.i)))
    buckets = [x.b for x in rows]
    assert buckets == sorted(buckets) and 0 <= buckets[0] and buckets[-1] <= len(bounds) < 16
    assert [sort_key(b) for b in bounds] == sorted(sort_key(b) for b in bounds)


def test_runs_are_about_equal_and_one_far_value_changes_nothing(spark):
    df = spark.range(20_000).union(spark.createDataFrame([(2**60,)], "id long"))
    bounds = range_bounds(df, ["id"], parts=20)
    sizes = Counter(r[0] for r in df.select(bucket_of(df, ["id"], bounds)).collect())
    assert len(sizes) == 20 and max(sizes.values()) < 2 * 20_000 / 20


def test_a_repeated_key_is_a_run_of_its_own(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 5000).otherwise(F.col("id")).alias("t"))
    bounds = range_bounds(df, ["t"], parts=10)
    sizes = Counter(r[0] for r in df.select(bucket_of(df, ["t"], bounds)).collect())
    assert sizes[len(bounds)] >= 1000 and sorted(sizes.values())[-2] < 800


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([], "t string")
    assert range_bounds(df, ["t"]) == []
    one = spark.createDataFrame([("x",)], "t string")
    assert [r[0] for r in one.select(bucket_of(one, ["t"], range_bounds(one, ["t"]))).collect()] == [0]


@pytest.mark.parametrize("given", [True, False])
def test_text_times_equal_lead_on_a_hot_key(spark, given):
    """One key holds most rows, all on one day; times are text, some null."""
    r = random.Random(8)
    rows = []
    for i in range(1500):
        time = None if r.random() < 0.03 else f"2018-03-0{r.choice([1, 1, 1, 2])} {r.randrange(24):02d}:{r.randrange(60):02d}:00"
        rows.append((r.choice([7, 7, 7, None, r.randrange(50)]), time, i))
    df = spark.createDataFrame(rows, "k long, t string, i long")
    bounds = range_bounds(df, ["t", "i"], parts=32, per_part=8) if given else None
    made = next_in_group(df, ["k"], ["t", "i"], ["t", "i"], bounds=bounds)
    want = df.selectExpr("*", SQL_LEAD.format(c="i", o="t") + " AS w", SQL_LEAD.format(c="t", o="t") + " AS wt")
    got = {x.i: (x.next_i, x.next_t, x._has_next) for x in made.collect()}
    assert got == {x.i: (x.w, x.wt, x.w is not None) for x in want.collect()}
    if given:
        own = df.where("k = 7").select(bucket_of(df, ["t", "i"], bounds).alias("b")).groupBy("b").count()
        assert own.agg(F.max("count")).first()[0] < 200
