"""Cohort operators: delivered orders, one row per person, the mature cohort.

Identity is two-level: a person (``customer_unique_id``) has one
``customer_id`` per order. Person-level facts come from one partial
(map-side) aggregate, so a person with a huge number of orders is combined
per map task before the shuffle instead of in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import with_share

PERSON = "customer_unique_id"


def delivered_orders(orders: DataFrame, customers: DataFrame, status: str = "delivered") -> DataFrame:
    """Orders of ``status`` with the ordering customer's person and state.

    All order columns are kept; the base of C1 and C7.
    """
    o = orders.where(F.col("order_status") == status)
    c = customers.select("customer_id", PERSON, "customer_state")
    return o.join(c, on="customer_id", how="inner")


def effective_orders(orders: DataFrame, customers: DataFrame, status: str = "delivered") -> DataFrame:
    """Delivered orders with person and state (step1_effective_orders)."""
    return delivered_orders(orders, customers, status).select(
        "order_id", "customer_id", PERSON, "customer_state", "order_purchase_timestamp"
    )


def latest_first(ts: str = "order_purchase_timestamp", tiebreak: str = "order_id") -> Column:
    """Ordering key whose maximum is the row PostgreSQL sorts first under
    ``ORDER BY ts DESC, tiebreak DESC`` (DESC puts nulls first)."""
    return F.struct(F.col(ts).isNull(), F.col(ts), F.col(tiebreak).isNull(), F.col(tiebreak))


def unique_customers(effective: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row per person: latest state, order count, first purchase.

    The latest state is the state of the person's latest order (ties broken
    by the larger order id; a null time counts as latest, as in the
    reference's DESC ordering). ``dedupe`` collapses repeated order rows
    first, as the reference's GROUP BY does.
    """
    rows = effective.select(PERSON, "customer_state", "order_id", "order_purchase_timestamp")
    if dedupe:
        rows = rows.dropDuplicates()
    return rows.groupBy(PERSON).agg(
        F.max_by("customer_state", latest_first()).alias("customer_state"),
        F.count("order_id").alias("total_orders"),
        F.min("order_purchase_timestamp").alias("first_purchase_time"),
    )


def order_count_distribution(people: DataFrame) -> DataFrame:
    """People per number of orders, with share of people."""
    counts = people.groupBy("total_orders").agg(F.count(F.lit(1)).alias("customer_count"))
    return with_share(counts, "customer_count", "pct_of_customers").orderBy(F.col("total_orders").desc())


def cutoff_literal(cutoff: str) -> Column:
    return F.lit(cutoff).cast("timestamp_ntz")


def mature_customers(people: DataFrame, cutoff: str) -> DataFrame:
    """C4: people whose first purchase is at or before ``cutoff``.

    ``cutoff`` is a timestamp; a bare date means midnight, so later
    purchases on that day are out, as in the reference.
    """
    return people.where(F.col("first_purchase_time") <= cutoff_literal(cutoff)).select(
        PERSON, "customer_state", "total_orders"
    )


def mature_orders(
    mature: DataFrame, customers: DataFrame, orders: DataFrame, status: str = "delivered"
) -> DataFrame:
    """Every delivered order of a mature person (the shared base).

    ``buyer_state`` is the person's latest state (from C2), which all the
    person's orders take; ``customer_state`` is the order's own record.
    Orders after the cutoff stay in: only the first purchase is limited.
    Joined on the person key; AQE splits a skewed person partition.
    """
    m = mature.select(PERSON, F.col("customer_state").alias("buyer_state"))
    return delivered_orders(orders, customers, status).join(m, on=PERSON, how="inner")


def cohort_grain(mature_orders: DataFrame) -> DataFrame:
    """Distinct people, customer records, orders, and joined rows, from
    the stored cohort orders; each key is reduced on its own."""
    names = {PERSON: "unique_customers", "customer_id": "customer_records", "order_id": "total_orders"}
    parts = [mature_orders.select(c).distinct().agg(F.count(c).alias(n)) for c, n in names.items()]
    parts.append(mature_orders.agg(F.count(F.lit(1)).alias("joined_rows")))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*[F.max(n).alias(n) for n in [*names.values(), "joined_rows"]])
