"""Sources: type normalisation of text timestamps and floating money, back-fill."""

import datetime as dt
from decimal import Decimal

from repurchase.sources import backfill_dim, normalize_types


def test_text_timestamps_and_float_money(spark):
    orders = spark.createDataFrame(
        [(1, "2017-10-02 10:56:33", "", None)],
        "order_id long, order_purchase_timestamp string, order_delivered_carrier_date string, order_delivered_customer_date string",
    )
    items = spark.createDataFrame([(1, 1, 29.99, 8.72)], "order_id long, order_item_id long, price double, freight_value double")
    reviews = spark.createDataFrame([("r", 1, "5")], "review_id string, order_id long, review_score string")
    t = normalize_types({"orders": orders, "order_items": items, "order_reviews": reviews})
    o = t["orders"].collect()[0]
    assert o.order_purchase_timestamp == dt.datetime(2017, 10, 2, 10, 56, 33)
    assert o.order_delivered_carrier_date is None  # dirty text becomes a missing date
    assert t["orders"].schema["order_purchase_timestamp"].dataType.simpleString() == "timestamp_ntz"
    i = t["order_items"].collect()[0]
    assert (i.price, i.freight_value) == (Decimal("29.99"), Decimal("8.72"))
    assert t["order_items"].schema["order_item_id"].dataType.simpleString() == "bigint"
    assert t["order_reviews"].collect()[0].review_score == 5


def test_backfill_is_idempotent(spark):
    dim = spark.createDataFrame([("a", "A")], "k string, v string")
    once = backfill_dim(dim, [("a", "X"), ("b", "B")], "k")
    twice = backfill_dim(once, [("a", "X"), ("b", "B")], "k")
    assert sorted(tuple(r) for r in twice.collect()) == [("a", "A"), ("b", "B")]


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, checkpoint=None):
        self.master = master
        self._checkpoint = checkpoint

    def getCheckpointDir(self):
        return self._checkpoint

    def setCheckpointDir(self, d):
        self._checkpoint = d


class _Session:
    def __init__(self, master, conf=None, checkpoint=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, checkpoint)


def test_cluster_session_without_shared_folder_refuses():
    import pytest

    from repurchase.sources import storage_root

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage_root(_Session("yarn"))
    assert storage_root(_Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/ckpt/"})) == "hdfs://nn/shared/ckpt"
    assert storage_root(_Session("yarn", checkpoint="hdfs://nn/ckpt/abc")) == "hdfs://nn/ckpt/abc"
