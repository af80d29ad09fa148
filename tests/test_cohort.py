"""Cohort traps: two-level identity, latest state with ties and nulls, cutoff."""

import datetime as dt

from repurchase.operators import cohort

T = dt.datetime


def _orders(spark, rows):
    return spark.createDataFrame(
        rows, "order_id long, customer_id long, order_status string, order_purchase_timestamp timestamp_ntz"
    )


def test_latest_state_ties_and_null_time(spark):
    customers = spark.createDataFrame(
        [(1, 100, "A"), (2, 100, "B"), (3, 200, "A"), (4, 200, "C"), (5, 300, "D"), (6, 300, "E")],
        "customer_id long, customer_unique_id long, customer_state string",
    )
    orders = _orders(
        spark,
        [
            (10, 1, "delivered", T(2020, 1, 1)),
            (11, 2, "delivered", T(2020, 2, 1)),  # person 100: later order in B
            (20, 3, "delivered", T(2020, 1, 1)),
            (21, 4, "delivered", T(2020, 1, 1)),  # person 200: tie, larger order id wins -> C
            (30, 5, "delivered", T(2020, 1, 1)),
            (31, 6, "delivered", None),  # person 300: null time sorts first under DESC -> E
            (40, 1, "shipped", T(2021, 1, 1)),  # not delivered: ignored
        ],
    )
    people = {r.customer_unique_id: r for r in cohort.unique_customers(cohort.effective_orders(orders, customers)).collect()}
    assert people[100].customer_state == "B" and people[100].total_orders == 2
    assert people[200].customer_state == "C"
    assert people[300].customer_state == "E" and people[300].first_purchase_time == T(2020, 1, 1)


def test_cutoff_is_midnight_and_orders_after_cutoff_stay(spark):
    customers = spark.createDataFrame([(1, 1, "A"), (2, 2, "A")], "customer_id long, customer_unique_id long, customer_state string")
    orders = _orders(
        spark,
        [(1, 1, "delivered", T(2018, 3, 7)), (2, 1, "delivered", T(2019, 1, 1)), (3, 2, "delivered", T(2018, 3, 7, 0, 0, 1))],
    )
    people = cohort.unique_customers(cohort.effective_orders(orders, customers))
    mature = cohort.mature_customers(people, "2018-03-07")
    assert [r.customer_unique_id for r in mature.collect()] == [1]
    mo = cohort.mature_orders(mature, customers, orders)
    assert sorted(r.order_id for r in mo.collect()) == [1, 2]
