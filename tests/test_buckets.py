"""Bucketed tables: joins and groups by their key without a shuffle."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from repurchase.operators import explore, logistics, marts
from repurchase.sources import Buckets, bucket_count
from repurchase.sources.buckets import evenly_dealt, open_bucketed, write_bucketed

from conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def by_merge(spark):
    """Only tables of a few rows (sellers, states) are broadcast, as where
    orders and items are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda limit: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def order_shuffles(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(order_id[^\n]*", plan(df))


def test_items_and_orders_meet_without_a_shuffle(spark, by_merge):
    a = E._analysis(spark, SMALL)
    orders, items, reviews, sellers = a.mature_orders, a.items, a.reviews, F.broadcast(a.sellers)
    by_merge(-1)
    frames = {
        "M0": marts.order_base(orders, items, sellers),
        "M0 reviews": marts.order_base(orders, items, sellers, reviews, dedupe_reviews=True),
        "L3": logistics.orders_without_items(orders, items),
        "L4": logistics.freight_profile(orders, items),
        "L5": logistics.freight_outliers_by_state(orders, items),
        "G2": logistics.cross_state_by_state(orders, items, sellers),
        "R2": logistics.review_distribution(orders, reviews),
        "E11": explore.items_per_order(items),
        "E12": explore.sellers_per_order(a.orders, items),
    }
    for name, df in frames.items():
        assert not order_shuffles(df), (name, plan(df))
    plain = spark.read.parquet(*items.inputFiles())
    assert order_shuffles(logistics.freight_profile(orders, plain))  # the test sees shuffles


def test_rows_are_the_same_as_from_plain_tables(spark):
    a = E._analysis(spark, SMALL)
    plain = spark.read.parquet(*a.items.inputFiles())
    got = logistics.freight_outliers_by_state(a.mature_orders, a.items).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, logistics.freight_outliers_by_state(a.mature_orders, plain).collect()), key=str)


def test_a_hot_key_is_stored_plainly(spark):
    folder = tempfile.mkdtemp(prefix="buckets-")
    hot = spark.range(60_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).alias("k"), "id")
    buckets = Buckets("k", 8)
    assert not evenly_dealt(hot, Buckets("k", 64)) and evenly_dealt(spark.range(60_000).withColumnRenamed("id", "k"), buckets)
    assert write_bucketed(hot, f"{folder}/hot", Buckets("k", 64)) is None
    assert spark.read.parquet(f"{folder}/hot").count() == 60_000


def test_null_keys_and_an_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="buckets-")
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k long, v long")
    for name, df in {"nulls": rows, "empty": rows.where("false")}.items():
        held = write_bucketed(df, f"{folder}/{name}", Buckets("k", 4))
        assert open_bucketed(spark, f"{folder}/{name}", df.schema, held).count() == df.count()


def test_bucket_counts_are_powers_of_two():
    assert [bucket_count(n, 100) for n in (0, 799, 801, 1700, 10**12)] == [8, 8, 16, 32, 1 << 16]


def test_a_state_with_most_rows_is_written_by_several_tasks(spark):
    """REBALANCE splits a large partition value and gathers small ones."""
    from repurchase.sources import write_table

    folder = tempfile.mkdtemp(prefix="rebalance-")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        df = spark.range(0, 40_000, 1, 4).selectExpr("if(id % 10 < 9, 'hot', concat('s', id % 100)) AS st", "sha2(string(id), 256) AS v")
        out = write_table(df, f"{folder}/t", ["st"])
    finally:
        spark.conf.set(size, before)
    files = {}
    for f in out.inputFiles():
        st = re.search(r"st=(\w+)/", f)[1]
        files[st] = files.get(st, 0) + 1
    assert out.count() == 40_000 and files["hot"] >= 4
    # A small state lies in one file, or in two where a cut falls into it.
    assert max(n for st, n in files.items() if st != "hot") <= 2
