"""The analysis as one object: tables + parameters -> every derived frame.

``Analysis`` builds each stage once, as a lazy plan or (with a store) as a
table written once and read back. ``publish`` is the production path: gate
on the constraint report, then write the stages and the marts as one snapshot
in the cluster's shared folder, so later stages and retries read files instead
of recomputing lineage after a lost executor.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import cohort, logistics, marts, quality
from ..sources.buckets import Buckets, bucket_count, plan_bytes
from ..sources.snapshots import Snapshots
from ..sources.tables import backfill_dim
from .params import CONSISTENCY_TABLES, FIXTURE, Params
from .stages import StageStore, TransactionStore


class Analysis:
    """Stages of the analysis over ``tables`` with ``params``.

    With a ``store`` the cohort stages are written once and read back (see
    ``plans.stages``); without one they stay lazy plans.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        params: Params = FIXTURE,
        store: StageStore | TransactionStore | None = None,
        buckets: Buckets | None = None,
    ):
        self.t = tables
        self.p = params
        self.store = store
        # Stored stages of one row per order lie in the buckets of the order table.
        self.buckets = replace(buckets, unique=True) if buckets else None
        self.checked: DataFrame | None = None  # a constraint report already stored

    @classmethod
    def with_stages(cls, tables: Mapping[str, DataFrame], params: Params, stages: Mapping[str, DataFrame]) -> "Analysis":
        """An analysis whose cohort stages are given (e.g. as published)."""
        a = cls(tables, params)
        for name in STAGES:
            if name in stages:
                a.__dict__[name] = stages[name]
        a.checked = stages.get("constraint_report")
        if all(name in stages for name in CONSISTENCY_TABLES[1:]):
            a.__dict__["stored_marts"] = tuple(stages[name] for name in CONSISTENCY_TABLES[1:])
        return a

    def _stage(self, name: str, build, by_order: bool = False) -> DataFrame:
        if self.store is None:
            return build()
        return self.store.get(name, build, buckets=self.buckets if by_order else None)

    # -- inputs --------------------------------------------------------
    @property
    def orders(self) -> DataFrame:
        return self.t["orders"]

    @property
    def customers(self) -> DataFrame:
        return self.t["customers"]

    @property
    def items(self) -> DataFrame:
        return self.t["order_items"]

    @property
    def sellers(self) -> DataFrame:
        return self.t["sellers"]

    @property
    def products(self) -> DataFrame:
        return self.t["products"]

    @property
    def translation(self) -> DataFrame:
        return self.t["product_category_name_translation"]

    @property
    def reviews(self) -> DataFrame:
        return self.t["order_reviews"]

    @cached_property
    def translation_filled(self) -> DataFrame:
        key, columns = "product_category_name", ["product_category_name", "product_category_name_english"]
        return self._stage("translation_filled", lambda: backfill_dim(self.translation, self.p.backfill_categories, key, columns))

    @cached_property
    def tables_filled(self) -> dict[str, DataFrame]:
        return dict(self.t, product_category_name_translation=self.translation_filled)

    # -- cohort stages ---------------------------------------------------
    @cached_property
    def effective(self) -> DataFrame:
        return self._stage(
            "delivered",
            lambda: cohort.effective_orders(self.orders, self.customers, self.p.delivered_status),
        )

    @cached_property
    def people(self) -> DataFrame:
        return self._stage("people", lambda: cohort.unique_customers(self.effective))

    @cached_property
    def mature(self) -> DataFrame:
        return self._stage(
            "mature_people", lambda: cohort.mature_customers(self.people, self.p.maturity_cutoff)
        )

    @cached_property
    def mature_orders(self) -> DataFrame:
        return self._stage(
            "mature_orders",
            lambda: cohort.mature_orders(self.mature, self.customers, self.orders, self.p.delivered_status),
            by_order=True,
        )

    @cached_property
    def base(self) -> DataFrame:
        return self._stage("order_base", lambda: marts.order_base(self.mature_orders, self.items, self.sellers), by_order=True)

    @cached_property
    def base_reviews(self) -> DataFrame:
        return self._stage(
            "order_base_reviews",
            lambda: marts.order_base(self.mature_orders, self.items, self.sellers, self.reviews, dedupe_reviews=False),
        )

    @cached_property
    def base_reviews_dedup(self) -> DataFrame:
        return self._stage(
            "order_base_reviews_dedup",
            lambda: marts.order_base(self.mature_orders, self.items, self.sellers, self.reviews, dedupe_reviews=True),
        )

    @cached_property
    def shipping_sketches(self) -> DataFrame:
        return self._stage("shipping_sketches", lambda: logistics.shipping_sketches(self.mature_orders))

    # -- marts -------------------------------------------------------------
    def state_mart(self) -> DataFrame:
        return marts.state_mart(self.mature, self.base)

    def state_mart_reviews(self, dedupe: bool = False) -> DataFrame:
        base = self.base_reviews_dedup if dedupe else self.base_reviews
        return marts.state_mart_reviews(self.mature, base, self.p.low_review_max)

    @cached_property
    def stored_marts(self) -> tuple[DataFrame, DataFrame]:
        """Both state marts as stored tables (plans without a store)."""
        return (
            self._stage("mart_state", self.state_mart),
            self._stage("mart_state_reviews", self.state_mart_reviews),
        )

    @cached_property
    def stored_fact(self) -> DataFrame:
        """The person-level fact as a table partitioned by state."""
        if self.store is None:
            return self.customer_order_fact()
        return self.store.get("fact_customer_order_totals", self.customer_order_fact, partition_by="buyer_state")

    def customer_order_fact(self) -> DataFrame:
        return marts.customer_order_fact(self.mature_orders)

    def constraint_report(self) -> DataFrame:
        if self.checked is not None:
            return self.checked
        return quality.constraint_report(self.tables_filled, self.p.expected_failures)


STAGES = ("effective", "people", "mature", "mature_orders", "base", "base_reviews", "shipping_sketches")


def publish(tables: Mapping[str, DataFrame], params: Params, folder: str, order_buckets: int | None = None) -> dict[str, DataFrame]:
    """Gate, then write the cohort stages and the dashboard tables as one
    version of the snapshots under ``folder`` (use the cluster's shared folder).

    The back-filled translation and the constraint report are written first;
    ``ConstraintError`` is raised before anything else is written when a
    constraint fails that is not allow-listed. Nothing is seen of the run until
    all its tables are there: a run that fails leaves the version before it, and
    frames of earlier versions go on reading (``sources.snapshots``).

    Items and the order-keyed stages are stored in ``order_buckets`` buckets of
    the order id (default: by the size of the items), so that they meet without
    a shuffle. Returns the tables read back.
    """
    spark = next(iter(tables.values())).sparkSession
    run = Snapshots(spark, folder).begin(keep=False)
    filled = run.write("product_category_name_translation", Analysis(tables, params).translation_filled)
    tables = dict(tables, product_category_name_translation=filled)
    report = run.write("constraint_report", Analysis(tables, params).constraint_report())
    quality.assert_constraints(report)
    items = tables["order_items"]
    buckets = Buckets("order_id", order_buckets or bucket_count(plan_bytes(items)))
    tables["order_items"] = run.write("order_items", items, buckets=buckets)
    staged = Analysis(tables, params, TransactionStore(run), buckets)
    out = {name: getattr(staged, name) for name in STAGES}
    for name, mart in zip(CONSISTENCY_TABLES[1:], (staged.state_mart, staged.state_mart_reviews)):
        out[name] = run.write(name, mart())
    out["fact_customer_order_totals"] = run.write("fact_customer_order_totals", staged.customer_order_fact(), ["buyer_state"])
    run.commit()
    written = ("constraint_report", "order_items", "product_category_name_translation")
    return out | {name: run.frames[name] for name in written}


def open_published(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a published version (default: the latest), by name."""
    return Snapshots(spark, folder).open(version)


__all__ = ["Analysis", "STAGES", "open_published", "publish"]
