"""Cases that the driver's tables do not hold, on inline frames."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from repurchase.operators import cohort, explore, logistics, quality
from repurchase.plans.stages import publish_once
from repurchase.sources import backfill_dim, cast_losses, list_tables, normalize_types

MID = "/root/testdata/sf0.01"


def test_tier_of_the_null_state_only_has_no_state_list(spark):
    df = spark.createDataFrame([(None, 10, 9, 1, 90.0, 10.0), ("S1", 10, 5, 5, 50.0, 50.0)], "buyer_state string, total_unique_customers long, one_time_customers long, repeat_customers long, one_time_customer_ratio_percentage double, repeat_customer_ratio_percentage double")
    got = {r.retention_tier: r.included_states for r in explore.retention_tiers(df, (40.0, 30.0, 20.0)).collect()}
    assert got == {">= 40%": "S1", "< 20%": None}


def test_backfill_takes_columns_by_name(spark):
    dim = spark.createDataFrame([("English", "name")], "english string, name string")
    got = backfill_dim(dim, [("pc", "PC")], "name", ["name", "english"]).where("name = 'pc'").first()
    assert (got.name, got.english) == ("pc", "PC")


def test_key_text_keeps_the_place_of_a_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), (None, "a")], "x string, y string")
    pk = quality.PrimaryKey("pk", "t", ("x", "y"))
    assert {r.key_value for r in quality.pk_duplicate_report({"t": df}, [pk]).collect()} == {"a|<null>", "<null>|a"}
    assert sorted(r.key_value for r in quality.pk_null_rows({"t": df}, [pk]).collect()) == ["<null>|a"] * 2 + ["a|<null>"] * 2


def test_orders_without_review_make_the_zero_tier(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    reviews = spark.createDataFrame([(1, 1, 5), (2, 1, 3)], "review_id long, order_id long, review_score int")
    got = {r.review_score_tier: r.order_count for r in logistics.review_distribution(orders, reviews).collect()}
    assert got == {"5 Stars": 1, "0 (No Review)": 2}


def test_orphans_of_leads_and_categories(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "k string")
    parent = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in quality.fk_orphans(child, parent, "k", "k").collect()] == ["b"]
    assert sorted((r.k for r in quality.fk_orphans(child, parent, "k", "k", False, False).collect()), key=str) == [None, "b", "b"]


def test_multi_seller_orders_count_sellers_once(spark):
    orders = spark.createDataFrame([(1, 1, "delivered"), (2, 1, "delivered")], "order_id long, customer_id long, order_status string")
    items = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, 10)], "order_id long, seller_id long")
    sellers = spark.createDataFrame([(10, "S1"), (11, "S2")], "seller_id long, seller_state string")
    customers = spark.createDataFrame([(1, "S1")], "customer_id long, customer_state string")
    got = explore.multi_seller_geography(orders, items, sellers, customers).collect()
    assert [(r.geographic_distribution_type[:2], r.order_count) for r in got] == [("2.", 1)]


def test_cohort_grain_plan_has_no_join_or_expand(spark):
    df = spark.createDataFrame([(1, 5, 7), (1, 6, 8), (2, 9, 8)], "customer_unique_id long, customer_id long, order_id long")
    out = cohort.cohort_grain(df)
    assert tuple(out.first()) == (2, 3, 2, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan


def test_stored_fact_of_two_folders_in_one_session(spark):
    first = E.queries()["S2_write_table"](spark, SMALL)
    n = first.count()
    second = E.queries()["S2_write_table"](spark, MID)
    assert second.count() > n and first.count() == n
    assert E.queries()["S4_show_fact"](spark, SMALL).count() == n


def test_first_of_two_writers_wins(spark, tmp_path):
    path = str(tmp_path / "stage")
    publish_once(spark.range(3), path)
    publish_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_consistency_check_reads_stored_marts(spark):
    plan = E.queries()["M3_mart_consistency"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    got = E.queries()["M3_mart_consistency"](spark, SMALL).select(F.count("*"), F.max("total_unique_customers")).first()
    assert got[0] == 3 and got[1] == 90


def test_cast_losses_count_dirty_values(spark):
    raw = {"order_reviews": spark.createDataFrame([("5",), ("x",), (None,)], "review_score string"), "sellers": spark.range(1)}
    got = cast_losses(raw, normalize_types(raw)).collect()
    assert [tuple(r) for r in got] == [("order_reviews", "review_score", 1)]


def test_tables_of_a_folder_are_listed(spark):
    assert {"orders", "lineitem", "documents"} <= set(list_tables(spark, SMALL))
