"""Repeated sellers, look-alike keys and times kept as text."""

from pyspark.sql import functions as F

from repurchase.operators import explore, quality


def geography(spark, sellers, items):
    orders = spark.createDataFrame([(o, o, "delivered") for o in (1, 2, 3)], "order_id long, customer_id long, order_status string")
    customers = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "customer_id long, customer_state string")
    df = explore.multi_seller_geography(
        orders,
        spark.createDataFrame(items, "order_id long, seller_id long"),
        spark.createDataFrame(sellers, "seller_id long, seller_state string"),
        customers,
    )
    return {r.geographic_distribution_type: r.order_count for r in df.collect()}


def test_a_seller_listed_twice_is_one_seller(spark):
    twice = [(10, "A"), (10, "A"), (11, "B"), (12, None), (12, None)]
    assert geography(spark, twice, [(1, 10), (1, 10), (2, 11), (3, 12)]) == {}
    once = geography(spark, [(10, "A"), (11, "B"), (12, None)], [(1, 10), (1, 11), (2, 10), (3, 10), (3, 12)])
    assert geography(spark, twice, [(1, 10), (1, 11), (2, 10), (3, 10), (3, 12)]) == once and sum(once.values()) == 2


def test_a_seller_in_two_states_is_one_seller_of_both(spark):
    sellers = [(10, "A"), (10, "B"), (11, "A")]
    assert geography(spark, sellers, [(1, 10)]) == {}
    both = geography(spark, sellers, [(1, 10), (1, 11)])
    assert both == geography(spark, [(10, "B"), (11, "A")], [(1, 10), (1, 11)])


def test_key_texts_tell_keys_apart(spark):
    keys = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("<null>", "x"), ("a\\", "b"), ("a", "\\b"), ("a\\|b", "c"), ("\\<null>", "x")]
    df = spark.createDataFrame(keys, "k string, l string")
    texts = [r[0] for r in df.select(quality._key_text(["k", "l"])).collect()]
    assert len(set(texts)) == len(keys) and "<null>|x" in texts


def test_gaps_between_text_times(spark):
    rows = [(1, "u", "2018-01-01 00:00:00"), (2, "u", "2018-01-03 12:00:00"), (3, "u", None), (4, "v", "2018-01-01 00:00:00")]
    text = spark.createDataFrame(rows, "order_id long, customer_unique_id string, order_purchase_timestamp string")
    timed = text.withColumn("order_purchase_timestamp", F.col("order_purchase_timestamp").cast("timestamp_ntz"))
    cols = ("order_id", "next_order_id", "gap_us")
    got = explore.order_sequences(text).select(*cols).collect()
    assert got == explore.order_sequences(timed).select(*cols).collect() and [tuple(r) for r in got] == [(1, 2, 216_000_000_000)]
