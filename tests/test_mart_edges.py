"""Mart edge cases on inline frames: empty groups and zero denominators."""

import datetime as dt

from repurchase.operators import marts

T = dt.datetime


def _base(spark, rows):
    return spark.createDataFrame(
        rows,
        "order_id long, customer_unique_id long, buyer_state string, price_cents long, freight_cents long, "
        "is_cross_state int, shipping_us long",
    )


def test_state_without_intra_orders_and_unmatched_state(spark):
    mature = spark.createDataFrame(
        [(1, "A", 2), (2, "A", 1), (3, "B", 1), (4, None, 3)], "customer_unique_id long, customer_state string, total_orders long"
    )
    day = 86_400_000_000
    base = _base(
        spark,
        [
            (10, 1, "A", 1000, 500, 1, 2 * day),
            (11, 1, "A", 1000, 1500, 1, 4 * day),
            (12, 2, "A", 0, 0, 1, 0),  # price + freight = 0: ratio skipped
            (20, 3, "B", 100, 100, 0, day),
            (40, 4, None, 100, 100, 0, day),  # null state: never joins
        ],
    )
    rows = {r.buyer_state: r for r in marts.state_mart(mature, base).collect()}
    a, b, n = rows["A"], rows["B"], rows[None]
    assert a.total_customers_mature == 2 and a.total_orders_mature == 3
    assert a.intra_median_freight is None and a.cross_median_freight == 5.0
    assert a.cross_state_freight_diff is None and a.cross_state_freight_premium_ratio is None
    assert a.intra_avg_days is None and a.cross_avg_days == 2.0
    assert a.avg_order_freight_ratio_percentage == round((500 / 1500 + 1500 / 2500) / 2 * 100, 2)
    assert a.freight_inverse_order_ratio_percentage == 33.33
    assert a.retention_rate_percentage == 50.0
    assert b.cross_state_ratio_percentage == 0.0 and b.cross_median_days is None
    assert n.total_orders_mature == 0 and n.avg_order_price is None and n.retention_rate_percentage == 100.0


def test_review_mart_without_reviews(spark):
    mature = spark.createDataFrame([(1, "A", 1)], "customer_unique_id long, customer_state string, total_orders long")
    base = spark.createDataFrame(
        [(10, 1, "A", 100, 10, 0, 0, None)],
        "order_id long, customer_unique_id long, buyer_state string, price_cents long, freight_cents long, "
        "is_cross_state int, shipping_us long, order_review_score int",
    )
    r = marts.state_mart_reviews(mature, base).collect()[0]
    assert r.avg_review_score is None
    assert r.intra_low_review_ratio is None and r.cross_low_review_ratio is None
    assert r.cross_low_review_ratio_multiplier is None
    assert r.intra_median_days == 0.0
