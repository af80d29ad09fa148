"""State-level and person-level marts for dashboards (M0-M6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
    US_PER_DAY,
    cents,
    micros_between,
    pct,
    percentiles_of_counts,
    round_double,
    round_ratio,
    round_ratio_int,
    scaled,
    tier,
    value_counts,
    with_share,
)
from ..plans.params import CONSISTENCY_TABLES, FILTER_REASONS
from .cohort import PERSON
from .logistics import order_review_scores

def ship_us() -> Column:
    """Carrier-to-customer time in microseconds."""
    return micros_between("order_delivered_carrier_date", "order_delivered_customer_date")


def order_base(
    mature_orders: DataFrame,
    items: DataFrame,
    sellers: DataFrame,
    reviews: DataFrame | None = None,
    dedupe_reviews: bool = False,
) -> DataFrame:
    """M0: one row per cohort order with both delivery dates and a
    non-negative shipping time.

    Price and freight are summed over items (in cents), an order is
    cross-state if any seller is in another state than the person's latest
    state, shipping is carrier-to-customer time. With ``reviews`` the order's
    highest score is added; raw reviews (``dedupe_reviews=False``) fan out
    the item rows exactly as the reference's mart does, inflating sums of
    multi-review orders; ``True`` reduces reviews to one row per order first.
    """
    o = mature_orders.where(
        F.col("order_delivered_carrier_date").isNotNull() & F.col("order_delivered_customer_date").isNotNull()
    ).select("order_id", PERSON, "buyer_state", ship_us().alias("_ship_us"))
    # The cohort's orders cut the items down before sellers are looked up.
    rows = o.join(items.select("order_id", "seller_id", "price", "freight_value"), on="order_id").join(sellers, on="seller_id")
    aggs = [
        cents(F.sum("price")).alias("price_cents"),
        cents(F.sum("freight_value")).alias("freight_cents"),
        F.max(F.when(F.col("buyer_state") != F.col("seller_state"), F.lit(1)).otherwise(F.lit(0))).alias("is_cross_state"),
        F.max("_ship_us").alias("shipping_us"),
    ]
    if reviews is not None:
        r = order_review_scores(reviews) if dedupe_reviews else reviews.select("order_id", "review_score")
        rows = rows.join(r, on="order_id", how="left")
        aggs.append(F.max("review_score").alias("order_review_score"))
    return rows.groupBy("order_id", PERSON, "buyer_state").agg(*aggs).where(F.col("shipping_us") >= 0)


def order_base_view(base: DataFrame) -> DataFrame:
    """M0 in the reference's units: money as DOUBLE, shipping in days."""
    return base.select(
        "order_id",
        PERSON,
        "buyer_state",
        scaled("price_cents", 2).alias("total_order_price"),
        scaled("freight_cents", 2).alias("total_order_freight"),
        "is_cross_state",
        (F.col("shipping_us").cast("double") / F.lit(float(US_PER_DAY))).alias("shipping_days"),
    )


def state_retention(mature: DataFrame) -> DataFrame:
    """People per latest state and percent with more than one order."""
    return mature.groupBy(F.col("customer_state").alias("buyer_state")).agg(
        F.count(F.lit(1)).alias("total_customers_mature"),
        pct("count_if(total_orders > 1)", "count(1)").alias("retention_rate_percentage"),
    )


def _attach(retention: DataFrame, logistics: DataFrame) -> DataFrame:
    """Retention LEFT JOIN logistics (which carries the order count), on
    plain state equality (a null state never matches, as in the reference)."""
    return retention.join(logistics, on="buyer_state", how="left")


FREIGHT_SHARE = "(CAST(freight_cents AS DOUBLE) / CAST(NULLIF(price_cents + freight_cents, 0) AS DOUBLE) * 100.0D)"
INTRA_SQL = "is_cross_state = 0"
CROSS_SQL = "is_cross_state = 1"


def _agg(**named: str) -> list[Column]:
    return [F.expr(e).alias(n) for n, e in named.items()]


# Counted measures, then the same of either side, in the order of their ids.
_COUNTED = {"freight": "freight_cents", "days": "shipping_us"}
_SIDED = [*_COUNTED, *(f"intra_{m}" for m in _COUNTED), *(f"cross_{m}" for m in _COUNTED)]


def side_percentiles(base: DataFrame, requests: dict[str, tuple[str, int]]) -> DataFrame:
    """Percentiles per state of freight and shipping time, over all orders
    and over either side.

    Orders are counted once per (state, side, measure, value); the counts of
    both sides then add up to those of all orders, so an order is shuffled as
    two rows at most, whatever is asked for.
    """
    counts = value_counts(base, ["buyer_state", "is_cross_state"], _COUNTED)
    n = len(_COUNTED)
    both = any(m in _COUNTED for m, _ in requests.values())
    side = F.col("_m") + n * (1 + F.col("is_cross_state"))
    kinds = F.array(side, F.col("_m")) if both else F.array(side)
    spread = counts.select("buyer_state", F.explode(kinds).alias("_m"), "_v", "_c")
    merged = spread.groupBy("buyer_state", "_m", "_v").agg(F.sum("_c").alias("_c"))
    return percentiles_of_counts(merged, ["buyer_state"], _SIDED, requests)


def state_mart(mature: DataFrame, base: DataFrame) -> DataFrame:
    """M1: the state logistics and retention mart (23 columns). Flagship.

    Means of cents and microseconds are exact integer ratios; medians and
    quartiles are exact PERCENTILE_CONT; differences and the premium are
    taken from the already rounded values, as the reference does. The order
    count joins in from the same aggregate as the logistics measures.
    """
    plain = base.groupBy("buyer_state").agg(
        *_agg(
            total_orders_mature="count(DISTINCT order_id)",
            _n="count(1)",
            _price="sum(CAST(price_cents AS DECIMAL(38,0)))",
            _freight="sum(CAST(freight_cents AS DECIMAL(38,0)))",
            _cross=f"count_if({CROSS_SQL})",
            # Per order a whole number of 1e-10 percent, so that the sum does
            # not depend on the order in which tasks add.
            _ratio=f"sum(CAST(floor({FREIGHT_SHARE} * 1e10D + 0.5D) AS DECIMAL(38,0)))",
            _ratio_n=f"count({FREIGHT_SHARE})",
            _inverse="count_if(freight_cents > price_cents)",
            _intra_us=f"sum(CAST(CASE WHEN {INTRA_SQL} THEN shipping_us END AS DECIMAL(38,0)))",
            _intra_n=f"count(CASE WHEN {INTRA_SQL} THEN shipping_us END)",
            _cross_us=f"sum(CAST(CASE WHEN {CROSS_SQL} THEN shipping_us END AS DECIMAL(38,0)))",
            _cross_n=f"count(CASE WHEN {CROSS_SQL} THEN shipping_us END)",
        )
    )
    pcts = side_percentiles(
        base,
        {
            "_median_freight": ("freight", 50),
            "_intra_median_freight": ("intra_freight", 50),
            "_cross_median_freight": ("cross_freight", 50),
            "_q1_days": ("days", 25),
            "_median_days": ("days", 50),
            "_q3_days": ("days", 75),
            "_intra_median_days": ("intra_days", 50),
            "_cross_median_days": ("cross_days", 50),
        },
    )
    money_units, day_units, day = 100 * 100, 100 * US_PER_DAY, US_PER_DAY
    lg = plain.join(pcts, on="buyer_state", how="left").select(
        "buyer_state",
        "total_orders_mature",
        round_ratio("_price", "_n * 100", 2).alias("avg_order_price"),
        round_ratio("_freight", "_n * 100", 2).alias("avg_freight_value"),
        round_ratio("_median_freight", money_units, 2).alias("median_freight_value"),
        round_ratio("_ratio", "_ratio_n * 10000000000", 2).alias("avg_order_freight_ratio_percentage"),
        pct("_inverse", "_n").alias("freight_inverse_order_ratio_percentage"),
        pct("_cross", "_n").alias("cross_state_ratio_percentage"),
        round_ratio_int("_intra_median_freight", money_units, 2).alias("_intra_mf"),
        round_ratio_int("_cross_median_freight", money_units, 2).alias("_cross_mf"),
        round_ratio("_q1_days", day_units, 1).alias("total_q1_days"),
        round_ratio("_median_days", day_units, 1).alias("total_median_days"),
        round_ratio("_q3_days", day_units, 1).alias("total_q3_days"),
        round_ratio_int("_intra_us", f"_intra_n * {day}", 1).alias("_intra_avg"),
        round_ratio_int("_intra_median_days", day_units, 1).alias("_intra_md"),
        round_ratio_int("_cross_us", f"_cross_n * {day}", 1).alias("_cross_avg"),
        round_ratio_int("_cross_median_days", day_units, 1).alias("_cross_md"),
    )
    out = _attach(state_retention(mature), lg)
    return out.select(
        "buyer_state",
        "total_customers_mature",
        F.expr("coalesce(total_orders_mature, CAST(0 AS BIGINT))").alias("total_orders_mature"),
        "avg_order_price",
        "avg_freight_value",
        "median_freight_value",
        "avg_order_freight_ratio_percentage",
        "freight_inverse_order_ratio_percentage",
        "cross_state_ratio_percentage",
        scaled("_intra_mf", 2).alias("intra_median_freight"),
        scaled("_cross_mf", 2).alias("cross_median_freight"),
        scaled("_cross_mf - _intra_mf", 2).alias("cross_state_freight_diff"),
        round_ratio("_cross_mf", "_intra_mf", 2).alias("cross_state_freight_premium_ratio"),
        "total_q1_days",
        "total_median_days",
        "total_q3_days",
        scaled("_intra_avg", 1).alias("intra_avg_days"),
        scaled("_intra_md", 1).alias("intra_median_days"),
        scaled("_cross_avg", 1).alias("cross_avg_days"),
        scaled("_cross_md", 1).alias("cross_median_days"),
        scaled("_cross_md - _intra_md", 1).alias("cross_state_delivery_diff_median"),
        scaled("_cross_avg - _intra_avg", 1).alias("cross_state_delivery_diff_avg"),
        "retention_rate_percentage",
    ).orderBy(F.col("retention_rate_percentage").desc())


def state_mart_reviews(mature: DataFrame, base_reviews: DataFrame, low_review_max: int = 2) -> DataFrame:
    """M1 subset plus review score measures.

    ``base_reviews`` is ``order_base(..., reviews=...)``; whether reviews were
    reduced first (M2b) or not (M2, fan-out kept) is decided there.
    """
    low = f"order_review_score <= {int(low_review_max)}"
    rated = "order_review_score IS NOT NULL"
    plain = base_reviews.groupBy("buyer_state").agg(
        *_agg(
            total_orders_mature="count(DISTINCT order_id)",
            _n="count(1)",
            _cross=f"count_if({CROSS_SQL})",
            _inverse="count_if(freight_cents > price_cents)",
            _score_sum="sum(CAST(order_review_score AS BIGINT))",
            _score_n="count(order_review_score)",
            _intra_low=f"count_if({INTRA_SQL} AND {low})",
            _intra_rated=f"count_if({INTRA_SQL} AND {rated})",
            _cross_low=f"count_if({CROSS_SQL} AND {low})",
            _cross_rated=f"count_if({CROSS_SQL} AND {rated})",
        )
    )
    pcts = side_percentiles(
        base_reviews,
        {
            "_intra_median_freight": ("intra_freight", 50),
            "_cross_median_freight": ("cross_freight", 50),
            "_intra_median_days": ("intra_days", 50),
            "_cross_median_days": ("cross_days", 50),
        },
    )
    money_units, day_units = 100 * 100, 100 * US_PER_DAY
    lg = plain.join(pcts, on="buyer_state", how="left").select(
        "buyer_state",
        "total_orders_mature",
        pct("_cross", "_n").alias("cross_state_ratio_percentage"),
        pct("_inverse", "_n").alias("freight_inverse_order_ratio_percentage"),
        round_ratio("_intra_median_freight", money_units, 2).alias("intra_median_freight"),
        round_ratio("_cross_median_freight", money_units, 2).alias("cross_median_freight"),
        round_ratio("_intra_median_days", day_units, 1).alias("intra_median_days"),
        round_ratio("_cross_median_days", day_units, 1).alias("cross_median_days"),
        round_ratio("_score_sum", "_score_n", 2).alias("avg_review_score"),
        round_ratio_int("_intra_low * 100", "_intra_rated", 2).alias("_il"),
        round_ratio_int("_cross_low * 100", "_cross_rated", 2).alias("_cl"),
    )
    out = _attach(state_retention(mature), lg)
    return out.select(
        "buyer_state",
        "total_customers_mature",
        F.expr("coalesce(total_orders_mature, CAST(0 AS BIGINT))").alias("total_orders_mature"),
        "cross_state_ratio_percentage",
        "freight_inverse_order_ratio_percentage",
        "intra_median_freight",
        "cross_median_freight",
        "intra_median_days",
        "cross_median_days",
        "avg_review_score",
        scaled("_il", 2).alias("intra_low_review_ratio"),
        scaled("_cl", 2).alias("cross_low_review_ratio"),
        round_ratio("_cl", "_il", 2).alias("cross_low_review_ratio_multiplier"),
        "retention_rate_percentage",
    ).orderBy(F.col("retention_rate_percentage").desc())


def mart_consistency(mature: DataFrame, mart: DataFrame, mart_reviews: DataFrame) -> DataFrame:
    """M3: people and order totals of the cohort and of both marts."""
    a = mature.agg(
        F.count(F.lit(1)).alias("total_unique_customers"), F.sum("total_orders").cast("long").alias("total_orders_contributed")
    )
    parts = [a] + [
        m.agg(
            F.sum("total_customers_mature").cast("long").alias("total_unique_customers"),
            F.sum("total_orders_mature").cast("long").alias("total_orders_contributed"),
        )
        for m in (mart, mart_reviews)
    ]
    named = [p.select(F.lit(n).alias("table_name"), "*") for n, p in zip(CONSISTENCY_TABLES, parts)]
    return reduce(DataFrame.unionByName, named)


def filter_reasons(mature_orders: DataFrame) -> DataFrame:
    """M4: why each cohort order is kept or dropped by the marts."""
    missing = F.col("order_delivered_carrier_date").isNull() | F.col("order_delivered_customer_date").isNull()
    reason = tier([(missing, FILTER_REASONS[0]), (ship_us() < 0, FILTER_REASONS[1])], FILTER_REASONS[2])
    g = mature_orders.groupBy(reason.alias("filter_reason")).agg(F.count(F.lit(1)).alias("order_count"))
    return with_share(g, "order_count", "pct_of_orders").orderBy("filter_reason")


def customer_order_fact(mature_orders: DataFrame) -> DataFrame:
    """M5: per person and latest state, distinct orders with a clean
    shipping record. No item or seller join, so it can exceed M1's totals."""
    rows = mature_orders.where(
        F.col("order_delivered_carrier_date").isNotNull()
        & F.col("order_delivered_customer_date").isNotNull()
        & (ship_us() >= 0)
    )
    return rows.groupBy(PERSON, "buyer_state").agg(F.countDistinct("order_id").alias("total_orders"))


def top_categories(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    state: str,
    n: int = 10,
) -> DataFrame:
    """M6: the ``n`` categories with most items bought by customers of
    ``state`` (any order status; items without a category drop out).
    Ties at the limit go to the category name."""
    c = customers.where(F.col("customer_state") == state).select("customer_id", "customer_state")
    rows = (
        c.join(orders.select("order_id", "customer_id"), on="customer_id")
        .join(items.select("order_id", "product_id"), on="order_id")
        .join(products.select("product_id", "product_category_name"), on="product_id")
        .join(translation, on="product_category_name")
    )
    g = rows.groupBy(
        F.col("customer_state").alias("state"), F.col("product_category_name_english").alias("product_category")
    ).agg(F.count("product_id").alias("total_purchased"))
    return g.orderBy(F.col("total_purchased").desc(), F.col("product_category").asc()).limit(n)
