"""Exploration operators: ranges, status split, repeat purchase, gaps, order
structure and seller geography (E1-E13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import US_PER_DAY, days_at_most, micros_between, pct, round_ratio, round_ratio_int, tier, with_share
from ..plans.params import GAP_TIER_REST, GAP_TIERS, GEOGRAPHY_LABELS, SELLER_COUNT_LABELS
from ..plans.sequence import next_in_group
from .cohort import PERSON

TS = "order_purchase_timestamp"


def purchase_range(orders: DataFrame, status: str | None = None) -> DataFrame:
    """Earliest and latest purchase time and order count.

    Null purchase times are dropped; ``status`` restricts to one status.
    """
    rows = orders.where(F.col(TS).isNotNull())
    tag = ""
    if status is not None:
        rows = rows.where(F.col("order_status") == status)
        tag = f"{status}_"
    return rows.agg(
        F.min(TS).alias(f"earliest_{tag}purchase_time"),
        F.max(TS).alias(f"latest_{tag}purchase_time"),
        F.count(F.lit(1)).alias(f"{status}_orders" if status else "total_orders"),
    )


def status_ratio(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """All orders, orders of ``status``, and their percent."""
    rows = orders.where(F.col(TS).isNotNull())
    hit = F.count_if(F.col("order_status") == status)
    return rows.agg(F.count(F.lit(1)).alias("total_orders"), hit.alias(f"{status}_orders")).withColumn(
        f"{status}_ratio_percentage", pct(f"{status}_orders", "total_orders")
    )


def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status."""
    return orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("order_count"))


def new_customers_by_quarter(effective: DataFrame) -> DataFrame:
    """E5: people by the quarter of their first delivered purchase.

    ``effective`` is C1 (delivered orders with person and state)."""
    first = effective.groupBy(PERSON).agg(F.min(TS).alias("first_purchase_time"))
    by_q = first.groupBy(F.date_format("first_purchase_time", "yyyy-'Q'q").alias("first_purchase_quarter")).agg(
        F.count(F.lit(1)).alias("new_customers_count")
    )
    return with_share(by_q, "new_customers_count", "pct_of_total_new_customers").orderBy("first_purchase_quarter")


def _orders_per_person(effective: DataFrame, with_state: bool) -> DataFrame:
    rows = effective.where(F.col(TS).isNotNull())
    aggs = [F.countDistinct("order_id").alias("total_orders")]
    if with_state:
        # (ARRAY_AGG(state ORDER BY ts DESC))[1]; order id breaks ties.
        aggs.append(F.max_by("customer_state", F.struct(F.col(TS), F.col("order_id"))).alias("buyer_state"))
    return rows.groupBy(PERSON).agg(*aggs)


def repeat_overall(effective: DataFrame) -> DataFrame:
    """One-time vs repeat people, their percents, orders per person."""
    per = _orders_per_person(effective, with_state=False)
    one = F.count_if(F.col("total_orders") == 1)
    rep = F.count_if(F.col("total_orders") > 1)
    out = per.agg(
        F.count(F.lit(1)).alias("total_unique_customers"),
        one.alias("one_time_customers"),
        rep.alias("repeat_customers"),
        F.sum("total_orders").alias("total_orders"),
    )
    return out.select(
        "total_unique_customers",
        "one_time_customers",
        "repeat_customers",
        pct("one_time_customers", "total_unique_customers").alias("one_time_customer_ratio_percentage"),
        pct("repeat_customers", "total_unique_customers").alias("repeat_customer_ratio_percentage"),
        F.col("total_orders").cast("long").alias("total_orders"),
        round_ratio("total_orders", "total_unique_customers", 2).alias("avg_orders_per_customer"),
    )


def state_repeat_metrics(effective: DataFrame) -> DataFrame:
    """Per latest state: people, one-time, repeat, and both percents."""
    per = _orders_per_person(effective, with_state=True)
    g = per.groupBy("buyer_state").agg(
        F.count(F.lit(1)).alias("total_unique_customers"),
        F.count_if(F.col("total_orders") == 1).alias("one_time_customers"),
        F.count_if(F.col("total_orders") > 1).alias("repeat_customers"),
    )
    return g.withColumn(
        "one_time_customer_ratio_percentage", pct("one_time_customers", "total_unique_customers")
    ).withColumn("repeat_customer_ratio_percentage", pct("repeat_customers", "total_unique_customers"))


def repeat_by_state(effective: DataFrame) -> DataFrame:
    """E6's split per person's latest state."""
    return state_repeat_metrics(effective).orderBy(F.col("repeat_customer_ratio_percentage").desc())


def _fmt(x: float) -> str:
    return f"{x:g}"


def tier_labels(edges: Sequence[float]) -> list[str]:
    hi, mid, lo = edges
    return [f">= {_fmt(hi)}%", f"{_fmt(mid)}%-{_fmt(hi)}%", f"{_fmt(lo)}%-{_fmt(mid)}%", f"< {_fmt(lo)}%"]


def retention_tiers(state_metrics: DataFrame, edges: Sequence[float] = (4.0, 3.0, 2.0)) -> DataFrame:
    """States bucketed by repeat percent (the rounded state rate).

    Per tier: state count, sorted state list, summed people, weighted rate,
    and the plain mean of the rounded state rates (as the reference does).
    """
    hi, mid, lo = edges
    labels = tier_labels(edges)
    rate = F.col("repeat_customer_ratio_percentage")
    conds = [rate >= hi, (rate >= mid) & (rate < hi), (rate >= lo) & (rate < mid)]
    label = tier(list(zip(conds, labels[:3])), labels[3])
    order = tier(list(zip(conds, ["1", "2", "3"])), "4").cast("int")
    rate_units = F.round(rate * F.lit(100)).cast("long")
    g = state_metrics.groupBy(label.alias("retention_tier"), order.alias("tier_sort_order")).agg(
        F.count(F.lit(1)).alias("number_of_states"),
        # Null, not an empty text, where a tier has no named state.
        F.nullif(F.array_join(F.array_sort(F.collect_list("buyer_state")), ", "), F.lit("")).alias("included_states"),
        F.sum("total_unique_customers").cast("long").alias("total_customers"),
        F.sum("one_time_customers").cast("long").alias("one_time_customers"),
        F.sum("repeat_customers").cast("long").alias("repeat_customers"),
        F.sum(rate_units).alias("_rate_sum"),
        F.count(rate_units).alias("_rate_n"),
    )
    return (
        g.withColumn("weighted_retention_rate_percentage", pct("repeat_customers", "total_customers"))
        .withColumn("avg_state_retention_rate_percentage", round_ratio("_rate_sum", F.col("_rate_n") * 100, 2))
        .orderBy("tier_sort_order")
        .drop("tier_sort_order", "_rate_sum", "_rate_n")
    )


def order_sequences(effective: DataFrame) -> DataFrame:
    """Each delivered order with the same person's next order (time, id).

    Successor under (purchase time ASC NULLS LAST, order id); only pairs
    whose next time is not null are kept. Hot people are split (see
    plans.sequence). Times may be text that sorts as time does (ISO 8601); the
    gap of a text that is no time is null.
    """
    rows = effective.select(PERSON, "order_id", TS)
    seq = next_in_group(rows, keys=[PERSON], order=[TS, "order_id"], carry=[TS, "order_id"])
    text = effective.schema[TS].dataType.simpleString() == "string"
    start, end = (F.col(c).try_cast("timestamp_ntz") if text else F.col(c) for c in (TS, f"next_{TS}"))
    return seq.where(F.col(f"next_{TS}").isNotNull()).withColumn("gap_us", micros_between(start, end))


def gap_tier_column(us: str = "gap_us") -> F.Column:
    return tier(
        [(days_at_most(us, d), label) for d, label in GAP_TIERS],
        GAP_TIER_REST,
    )


def repurchase_intervals(effective: DataFrame) -> DataFrame:
    """Gaps to a person's next delivered order, in day tiers."""
    gaps = order_sequences(effective)
    g = gaps.groupBy(gap_tier_column().alias("repurchase_interval_tier")).agg(
        F.count(F.lit(1)).alias("repurchase_count"), F.sum(F.col("gap_us").cast("decimal(38,0)")).alias("_us")
    )
    g = g.withColumn("avg_days_within_tier", round_ratio("_us", F.col("repurchase_count") * F.lit(US_PER_DAY), 1))
    return with_share(g.drop("_us"), "repurchase_count", "pct_of_total_repurchases").orderBy("repurchase_interval_tier")


def longest_gaps(
    effective: DataFrame,
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    n: int = 200,
) -> DataFrame:
    """The ``n`` longest gaps with the category of the first order's item 1.

    Top-k runs first (each task keeps n candidates); the lookups then touch
    only the items of those n orders. Because the item join can only add rows,
    the top n joined rows all come from the top n gaps. Ties sort by person,
    order ids and category.
    """
    gaps = order_sequences(effective).select(
        F.col(PERSON).alias("buyer_id"),
        F.col("order_id").alias("first_order_id"),
        F.col(TS).alias("first_order_time"),
        F.col("next_order_id").alias("second_order_id"),
        F.col(f"next_{TS}").alias("second_order_time"),
        round_ratio_int("gap_us", F.lit(US_PER_DAY), 1).alias("_gap_tenths"),
    )
    rank = [F.col("_gap_tenths").desc(), F.col("buyer_id").asc(), F.col("first_order_id").asc(), F.col("second_order_id").asc()]
    top = gaps.orderBy(*rank).limit(n)
    first_items = items.where(F.col("order_item_id") == 1).select(F.col("order_id").alias("first_order_id"), "product_id")
    cats = products.join(translation, on="product_category_name", how="inner").select(
        "product_id", F.col("product_category_name_english").alias("first_order_category")
    )
    out = (
        top.join(first_items, on="first_order_id", how="left")
        .join(cats, on="product_id", how="left")
        .withColumn("gap_days", (F.col("_gap_tenths").cast("double") / F.lit(10.0)))
    )
    return out.orderBy(*rank, F.col("first_order_category").asc_nulls_first()).limit(n).select(
        "buyer_id",
        "first_order_id",
        "first_order_time",
        "second_order_id",
        "second_order_time",
        "gap_days",
        "first_order_category",
    )


def items_per_order(items: DataFrame) -> DataFrame:
    """How many orders have k items, and their share."""
    per = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    g = per.groupBy("item_count").agg(F.count(F.lit(1)).alias("order_count"))
    return with_share(g, "order_count", "pct_of_total_orders").orderBy("item_count")


def sellers_per_order(orders: DataFrame, items: DataFrame, status: str = "delivered") -> DataFrame:
    """Delivered orders by number of distinct sellers (1, 2, 3, 4+)."""
    o = orders.where(F.col("order_status") == status).select("order_id")
    per = o.join(items.select("order_id", "seller_id"), on="order_id", how="inner").groupBy("order_id").agg(
        F.countDistinct("seller_id").alias("n")
    )
    label = tier(
        [(F.col("n") == i + 1, lab) for i, lab in enumerate(SELLER_COUNT_LABELS[:3])],
        SELLER_COUNT_LABELS[3],
    )
    g = per.groupBy(label.alias("order_composition_type")).agg(F.count(F.lit(1)).alias("order_count"))
    return with_share(g, "order_count", "pct_of_total_delivered_orders").orderBy("order_composition_type")


def multi_seller_geography(
    orders: DataFrame, items: DataFrame, sellers: DataFrame, customers: DataFrame, status: str = "delivered"
) -> DataFrame:
    """Orders with two or more sellers, by buyer/seller state relation.

    Sellers are counted distinct, so a seller that ``sellers`` lists twice is
    one; all its states count among the order's.
    """
    o = (
        orders.where(F.col("order_status") == status)
        .select("order_id", "customer_id")
        .join(customers.select("customer_id", F.col("customer_state").alias("buyer_state")), on="customer_id")
    )
    # The cohort's orders cut the items down before sellers are looked up. A
    # seller listed in several states counts once, in the first of its states.
    first = F.row_number().over(Window.partitionBy("seller_id").orderBy("seller_state")) == 1
    places = sellers.select("seller_id", "seller_state").distinct().withColumn("_one", first.cast("long"))
    rows = o.join(items.select("order_id", "seller_id"), on="order_id").distinct().join(places, on="seller_id")
    by_state = rows.groupBy("order_id", "buyer_state", "seller_state").agg(F.sum("_one").alias("n"))
    per = (
        by_state.groupBy("order_id", "buyer_state")
        .agg(
            F.sum("n").alias("n_sellers"),
            F.count("seller_state").alias("n_states"),
            # With one distinct seller state, "that state = buyer state" is
            # bool_and over the items (nulls skipped, as MIN skips them); a
            # boolean buffer keeps the aggregate hash-based, where MIN over
            # a string would force a sort-based aggregate.
            F.bool_and(F.col("seller_state") == F.col("buyer_state")).alias("all_match"),
            F.bool_or(F.col("seller_state") == F.col("buyer_state")).alias("matched"),
        )
        .where(F.col("n_sellers") >= 2)
    )
    one, many = F.col("n_states") == 1, F.col("n_states") > 1
    label = tier(
        [
            (one & (F.col("all_match") == F.lit(True)), GEOGRAPHY_LABELS[0]),
            (many & (F.col("matched") == F.lit(True)), GEOGRAPHY_LABELS[1]),
            (one & (F.col("all_match") == F.lit(False)), GEOGRAPHY_LABELS[2]),
        ],
        GEOGRAPHY_LABELS[3],
    )
    g = per.groupBy(label.alias("geographic_distribution_type")).agg(F.count(F.lit(1)).alias("order_count"))
    return with_share(g, "order_count", "pct_of_multi_seller_orders").orderBy("geographic_distribution_type")
