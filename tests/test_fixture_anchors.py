"""The role-mapped tables reproduce the anchors in FIXTURES.md §4 (sf0.01)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from repurchase.operators import quality

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def a(spark):
    return E._analysis(spark, MID)


def test_table_anchors(a):
    t = a.t
    assert t["customers"].count() == 1500
    assert t["customers"].select("customer_unique_id").distinct().count() == 1350
    delivered = t["orders"].where("order_status = 'delivered'")
    assert delivered.count() == 4933
    assert delivered.where("order_delivered_carrier_date IS NOT NULL").count() == 4257
    assert delivered.where("order_delivered_customer_date IS NOT NULL").count() == 4313
    items = t["order_items"]
    assert items.count() == 60000
    sums = items.agg(F.sum("price"), F.sum("freight_value")).collect()[0]
    assert sums[0] == Decimal("56999365.30") and sums[1] == Decimal("31777014.86")
    assert quality.pk_duplicates(items, ["order_id", "order_item_id"]).count() == 11785
    assert quality.pk_duplicates(t["order_payments"], ["order_id", "payment_sequential"]).count() == 11785
    products = t["products"]
    assert products.count() == 2000 and products.where("product_category_name IS NOT NULL").count() == 1960
    assert quality.fk_orphans(products, t["product_category_name_translation"], "product_category_name", "product_category_name").count() == 0
    reviews = t["order_reviews"]
    assert reviews.count() == 15883 and reviews.select("order_id").distinct().count() == 15000
    closed = t["leads_closed"]
    assert closed.count() == 150
    assert quality.fk_orphans(closed, t["leads_qualified"], "mql_id", "mql_id").count() == 0
    assert quality.fk_orphans(closed, t["sellers"], "seller_id", "seller_id").count() == 50


def test_cohort_anchors(a):
    people = a.people
    assert people.count() == 1289
    assert people.where("total_orders > 1").count() == 1152
    assert a.mature.count() == 871
    assert a.mature_orders.count() == 3814
    reasons = {r.filter_reason[:2]: r.order_count for r in E.queries()["M4_filter_reasons"](a.orders.sparkSession, MID).collect()}
    assert reasons == {"1.": 953, "2.": 535, "3.": 2326}
    assert E.queries()["R1_multi_review_orders"](a.orders.sparkSession, MID).count() == 883


def test_multi_seller_geography_anchor(a):
    rows = E.queries()["E13_multi_seller_geography"](a.orders.sparkSession, MID).collect()
    counts = {r.geographic_distribution_type[:2]: r.order_count for r in rows}
    assert counts == {"1.": 14, "2.": 1868, "3.": 112, "4.": 2486}
