"""Logistics, review and geography profiles of the mature cohort
(L1-L5, R1-R2, G1-G2). Inputs are the shared cohort base (C7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    US_PER_DAY,
    cents,
    days_over,
    micros_between,
    money_over,
    pct,
    percentiles_of_counts,
    round_ratio,
    tier,
    with_share,
)
from ..functions.sketches import merge_sketches, month_sketches, percentiles
from ..plans.params import REVIEW_LABELS, REVIEW_NONE
from .cohort import PERSON
from .quality import pk_duplicates

PROFILE_PERCENTILES = (("q1", 25), ("median", 50), ("q3", 75), ("p95", 95), ("p99", 99))


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (no join)."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return merged.agg(*[F.max(c).alias(c) for c in cols])


def _profile(values: DataFrame, measure: str, unit: int, dp: int, name: str, over_label: str, over) -> DataFrame:
    """Count, min, quartiles, p95, p99, max, negatives and outliers."""
    v, c = F.col(measure), F.col("_c")
    # All figures come from the counts of equal values, so the values are
    # made once; a null value counts as an order only.
    counts = values.groupBy(measure).agg(F.count(F.lit(1)).alias("_c"))
    none = F.lit(0).cast("long")
    stats = counts.agg(
        F.coalesce(F.sum(c), none).alias(f"total_valid_{name}_orders"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        F.coalesce(F.sum(F.when(v < 0, c)), none).alias(f"negative_{name}_orders"),
        F.coalesce(F.sum(F.when(over, c)), none).alias(over_label),
    )
    known = counts.where(v.isNotNull()).select(F.lit(0).alias("_m"), v.cast("long").alias("_v"), "_c")
    pcts = percentiles_of_counts(known, [], ["m"], {f"_{label}": ("m", p) for label, p in PROFILE_PERCENTILES})
    row = combine_rows(stats, pcts)
    suffix = "days" if name == "shipping" else "freight"
    out = [F.col(f"total_valid_{name}_orders"), round_ratio("_min", F.lit(unit), dp).alias(f"min_{suffix}")]
    out += [round_ratio(f"_{label}", F.lit(unit * 100), dp).alias(f"{label}_{suffix}") for label, _ in PROFILE_PERCENTILES]
    out += [
        round_ratio("_max", F.lit(unit), dp).alias(f"max_{suffix}"),
        F.col(f"negative_{name}_orders"),
        F.col(over_label),
    ]
    return row.select(*out)


def shipping_profile(mature_orders: DataFrame, over_days: int = 90) -> DataFrame:
    """L1: carrier-to-customer days of cohort orders.

    COUNT(*) includes orders without both dates; statistics skip them.
    """
    rows = mature_orders.select(
        micros_between("order_delivered_carrier_date", "order_delivered_customer_date").alias("us")
    )
    return _profile(rows, "us", US_PER_DAY, 2, "shipping", f"over_{over_days}_days_orders", days_over("us", over_days))


def shipping_sketches(mature_orders: DataFrame) -> DataFrame:
    """Carrier-to-customer microseconds by buyer state and month of purchase, as
    mergeable sketches: the stored form of L1 for any period."""
    rows = mature_orders.select(
        "buyer_state",
        "order_purchase_timestamp",
        micros_between("order_delivered_carrier_date", "order_delivered_customer_date").alias("us"),
    )
    return month_sketches(rows, ["buyer_state"], "order_purchase_timestamp", "us")


def shipping_between(
    sketches: DataFrame, start: str | None = None, end: str | None = None, by_state: bool = False
) -> DataFrame:
    """L1's days of the months from ``start`` up to ``end``, read from stored
    sketches: count, least and greatest are exact, percentiles within the
    sketches' rank error."""
    keys = ["buyer_state"] if by_state else []
    merged = percentiles(merge_sketches(sketches, keys, start, end), {f"_{name}": p for name, p in PROFILE_PERCENTILES})
    days = {"min_days": "low"} | {f"{name}_days": f"_{name}" for name, _ in PROFILE_PERCENTILES} | {"max_days": "high"}
    return merged.select(
        *keys,
        F.col("n_rows").alias("total_valid_shipping_orders"),
        *[round_ratio(c, F.lit(US_PER_DAY), 2).alias(name) for name, c in days.items()],
    )


def outliers_by_state(per_order: DataFrame, is_outlier, label: str) -> DataFrame:
    """Outlier orders per buyer state: count, share in state (4 dp), share of
    all outliers (2 dp). One aggregate replaces the reference's two plus a
    join; a null state gets 0 outliers, as its join never matched."""
    g = per_order.groupBy("buyer_state").agg(
        F.count_if(is_outlier).alias("_hits"), F.count(F.lit(1)).alias("total_state_orders")
    )
    g = g.withColumn(label, F.when(F.col("buyer_state").isNull(), F.lit(0).cast("long")).otherwise(F.col("_hits")))
    total = F.sum(label).over(Window.partitionBy())
    return (
        g.select(
            "buyer_state",
            label,
            "total_state_orders",
            pct(label, "total_state_orders", 4).alias("pct_within_state"),
            pct(F.col(label), total, 2).alias("pct_of_total_outliers"),
        )
        .orderBy(F.col(label).desc(), F.col("total_state_orders").desc())
    )


def slow_orders_by_state(mature_orders: DataFrame, over_days: int = 90) -> DataFrame:
    """L2: purchase-to-customer days over ``over_days`` per buyer state."""
    rows = mature_orders.where(
        F.col("order_purchase_timestamp").isNotNull() & F.col("order_delivered_customer_date").isNotNull()
    ).select(
        "buyer_state", micros_between("order_purchase_timestamp", "order_delivered_customer_date").alias("us")
    )
    return outliers_by_state(rows, days_over("us", over_days), f"orders_over_{over_days}_days")


def orders_without_items(mature_orders: DataFrame, items: DataFrame) -> DataFrame:
    """L3: cohort orders with no item rows (anti join)."""
    return mature_orders.join(items.select("order_id"), on="order_id", how="left_anti").select(
        "order_id", PERSON, "order_purchase_timestamp", "order_status"
    )


def order_freight(mature_orders: DataFrame, items: DataFrame, with_state: bool = False) -> DataFrame:
    """Freight per cohort order (sum over its items), in cents."""
    keys = ["order_id", "buyer_state"] if with_state else ["order_id"]
    rows = mature_orders.select(*keys).join(items.select("order_id", "freight_value"), on="order_id")
    return rows.groupBy(*keys).agg(cents(F.sum("freight_value")).alias("freight_cents"))


def freight_profile(mature_orders: DataFrame, items: DataFrame, over: int = 150) -> DataFrame:
    """L4: freight per order: count, min, quartiles, p95, p99, max, outliers."""
    per = order_freight(mature_orders, items)
    return _profile(per, "freight_cents", 100, 2, "freight", f"over_{over}_freight_orders", money_over("freight_cents", over))


def freight_outliers_by_state(mature_orders: DataFrame, items: DataFrame, over: int = 150) -> DataFrame:
    """Orders with freight over ``over`` per buyer state."""
    per = order_freight(mature_orders, items, with_state=True)
    return outliers_by_state(per, money_over("freight_cents", over), f"orders_over_{over}_freight")


def multi_review_orders(reviews: DataFrame) -> DataFrame:
    """Orders with more than one review."""
    return pk_duplicates(reviews, ["order_id"])


def order_review_scores(reviews: DataFrame) -> DataFrame:
    """One score per order: the highest (reduces the 1-to-many review fan-out)."""
    return reviews.groupBy("order_id").agg(F.max("review_score").alias("review_score"))


def review_distribution(mature_orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """R2: cohort orders by review score (0 = no review), with share."""
    rows = mature_orders.select("order_id").join(order_review_scores(reviews), on="order_id", how="left")
    score = F.coalesce(F.col("review_score"), F.lit(0))
    g = rows.groupBy(score.alias("_score")).agg(F.count(F.lit(1)).alias("order_count"))
    label = tier([(F.col("_score") == s, lab) for s, lab in REVIEW_LABELS], REVIEW_NONE)
    g = with_share(g, "order_count", "pct_of_total_orders")
    return g.orderBy(F.col("_score").desc()).select(label.alias("review_score_tier"), "order_count", "pct_of_total_orders")


def multi_state_people(mature_orders: DataFrame) -> DataFrame:
    """G1: cohort people whose orders carry more than one state."""
    per = mature_orders.groupBy(PERSON).agg(F.countDistinct("customer_state").alias("state_count"))
    out = per.agg(
        F.count(F.lit(1)).alias("total_mature_customers"),
        F.count_if(F.col("state_count") > 1).alias("mature_customers_with_multiple_states"),
    )
    return out.withColumn(
        "multiple_state_customer_percentage", pct("mature_customers_with_multiple_states", "total_mature_customers")
    )


def cross_state_by_state(mature_orders: DataFrame, items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Per buyer state, cross-state share at order, item and mixed level.

    A seller in another state than the person's latest state makes an item
    cross-state; a null state on either side counts as neither.
    """
    # The cohort's orders cut the items down before sellers are looked up.
    rows = mature_orders.select("order_id", "buyer_state").join(items.select("order_id", "seller_id"), on="order_id").join(sellers, on="seller_id")
    per = rows.groupBy("order_id", "buyer_state").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("buyer_state") != F.col("seller_state")).alias("cross_items"),
        F.count_if(F.col("buyer_state") == F.col("seller_state")).alias("intra_items"),
    )
    g = per.groupBy("buyer_state").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("cross_items") > 0).alias("_any"),
        F.sum("cross_items").alias("_cross"),
        F.sum("total_items").alias("_items"),
        F.count_if((F.col("cross_items") > 0) & (F.col("intra_items") > 0)).alias("_mixed"),
    )
    return g.select(
        "buyer_state",
        "total_orders",
        pct("_any", "total_orders").alias("any_item_cross_state_order_ratio"),
        pct("_cross", "_items").alias("item_level_cross_state_ratio"),
        pct("_mixed", "total_orders").alias("mixed_order_ratio"),
    ).orderBy(F.col("any_item_cross_state_order_ratio").desc())
