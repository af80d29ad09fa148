"""Mergeable percentiles against exact ranks; exact sums in any order; counts
taken while copying."""

import bisect
import random
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from repurchase.functions.sketches import K, RANK_ERROR, merge_sketches, month_sketches, percentiles
from repurchase.operators import logistics, marts
from repurchase.sources import Buckets, Snapshots, copy_tables

from conftest import SMALL

ASKED = {"p25": 25, "p50": 50, "p75": 75, "p95": 95, "p99": 99}


def rank_error(value, ordered, percent):
    """How far the ranks that ``value`` takes are from the one asked for."""
    lo, hi = bisect.bisect_left(ordered, value) / len(ordered), bisect.bisect_right(ordered, value) / len(ordered)
    p = percent / 100
    return 0 if lo <= p <= hi else min(abs(lo - p), abs(hi - p))


def test_months_merge_to_any_period_within_the_rank_error(spark):
    r = random.Random(2)
    rows = [(r.choice("AAAB"), f"2020-{r.randrange(1, 13):02d}-15 10:00:00", None if r.random() < 0.02 else int(r.lognormvariate(10, 2))) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "st string, t string, v long").withColumn("t", F.col("t").cast("timestamp_ntz"))
    months = month_sketches(df.repartition(5), ["st"], "t", "v").cache()
    assert months.count() == 24
    for start, end in ((None, None), ("2020-03-01", "2020-08-01")):
        for keys in ([], ["st"]):
            for got in percentiles(merge_sketches(months, keys, start, end), ASKED).collect():
                own = [v for st, t, v in rows if (start is None or start <= t < end) and (not keys or st == got.st)]
                known = sorted(v for v in own if v is not None)
                assert (got.n_rows, got.n, got.low, got.high) == (len(own), len(known), known[0], known[-1])
                for name, p in ASKED.items():
                    assert got[name] in set(known) and rank_error(got[name], known, p) <= RANK_ERROR
    # A sketch's size follows k, not the rows.
    assert max(len(r.sketch) for r in months.collect()) < 64 * K


def test_a_period_without_values(spark):
    df = spark.createDataFrame([("A", None, None), ("A", None, 5)], "st string, t timestamp_ntz, v long")
    months = month_sketches(df, ["st"], "t", "v")
    none = percentiles(merge_sketches(months, [], "2020-01-01"), ASKED).collect()[0]
    assert (none.n_rows, none.n, none.low, none.p50) == (0, 0, None, None)
    only = percentiles(merge_sketches(month_sketches(df.where("v is null"), ["st"], "t", "v")), ASKED).collect()[0]
    assert (only.n_rows, only.n, only.p50) == (1, 0, None)
    assert percentiles(merge_sketches(months), ASKED).collect()[0].p50 == 5


def test_shipping_of_all_months_is_near_the_exact_profile(spark):
    a = E._analysis(spark, SMALL)
    exact = logistics.shipping_profile(a.mature_orders).collect()[0]
    near = logistics.shipping_between(a.shipping_sketches).collect()[0]
    assert (near.total_valid_shipping_orders, near.min_days, near.max_days) == (exact.total_valid_shipping_orders, exact.min_days, exact.max_days)
    ordered = sorted(r[0] for r in a.mature_orders.select(logistics.micros_between("order_delivered_carrier_date", "order_delivered_customer_date")).collect() if r[0] is not None)
    days = [us / logistics.US_PER_DAY for us in ordered]
    for name, p in logistics.PROFILE_PERCENTILES:
        lo, hi = (days[max(0, min(len(days) - 1, round(len(days) * (p / 100 + e))))] for e in (-RANK_ERROR, RANK_ERROR))
        assert lo - 0.01 <= near[f"{name}_days"] <= hi + 0.01
    assert logistics.shipping_between(a.shipping_sketches, by_state=True).count() == a.mature_orders.select("buyer_state").distinct().count()


def test_the_mean_of_ratios_is_bit_equal_in_any_partitioning(spark):
    r = random.Random(6)
    rows = [(i, f"u{i}", "S", r.randrange(1, 10**7), r.randrange(10**6), i % 2, i) for i in range(4000)]
    base = spark.createDataFrame(rows, "order_id long, customer_unique_id string, buyer_state string, price_cents long, freight_cents long, is_cross_state int, shipping_us long")
    mature = spark.createDataFrame([("u1", "S", 2)], "customer_unique_id string, customer_state string, total_orders long")
    seen = {tuple(marts.state_mart(mature, base.repartition(n)).collect()[0]) for n in (1, 7, 200)}
    assert len(seen) == 1


def test_counts_are_taken_while_copying(spark):
    raw = {
        "orders": spark.createDataFrame(
            [(1, "2017-10-02 10:56:33", "", None), (2, "no time", None, None)],
            "order_id long, order_purchase_timestamp string, order_delivered_carrier_date string, order_delivered_customer_date string",
        ),
        "sellers": spark.createDataFrame([], "seller_id long, seller_state string"),
        "order_items": spark.createDataFrame([(1, 1, 2.5)] * 3, "order_id long, order_item_id long, price double"),
    }
    snaps = Snapshots(spark, tempfile.mkdtemp(prefix="copy-"))
    run = snaps.begin()
    copies, report = copy_tables(raw, run, {"order_items": Buckets("order_id", 4)})
    run.commit()
    assert set(report) == {
        ("orders", None, 2),
        ("orders", "order_purchase_timestamp", 1),
        ("orders", "order_delivered_carrier_date", 1),
        ("orders", "order_delivered_customer_date", 0),
        ("sellers", None, 0),
        ("order_items", None, 3),
        ("order_items", "price", 0),
    }
    assert copies["orders"].schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    assert snaps.table("order_items").count() == 3
