"""Key checks, orphan checks and the publishing gate on inline frames."""

import pytest

from repurchase.operators import quality as q


def test_pk_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (2, None)], "a long, b long")
    assert sorted(tuple(r) for r in q.pk_duplicates(df, ["a", "b"]).collect()) == [(1, 1, 2)]
    assert q.pk_nulls(df, ["a", "b"]).count() == 2


def test_fk_orphans_options(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "k long")
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    all_rows = sorted((r.k for r in q.fk_orphans(child, parent, "k", "k", distinct=False, exclude_null=False).collect()), key=str)
    assert all_rows == [9, 9, None] or sorted(all_rows, key=lambda x: (x is None, x)) == [9, 9, None]
    assert [r.k for r in q.fk_orphans(child, parent, "k", "k").collect()] == [9]
    s = q.fk_orphan_summary(child, parent, "k", "k").collect()[0]
    assert (s.unmatched_rows, s.unmatched_key_count) == (2, 1)


def _tables(spark, orphan=True):
    t = {
        "orders": spark.createDataFrame([(1, 10), (2, 11)], "order_id long, customer_id long"),
        "customers": spark.createDataFrame([(10,), (11,) if not orphan else (12,)], "customer_id long"),
    }
    return t


def test_constraint_report_and_gate(spark):
    pks = [q.PrimaryKey("pk_orders", "orders", ("order_id",))]
    fks = [q.ForeignKey("fk_orders_customer", "orders", "customer_id", "customers", "customer_id", False, False)]
    rep = q.constraint_report(_tables(spark), (), pks, fks)
    status = {r.constraint_name: (r.status, r.violations) for r in rep.collect()}
    assert status == {"pk_orders": ("pass", 0), "fk_orders_customer": ("fail", 1)}
    with pytest.raises(q.ConstraintError):
        q.assert_constraints(rep)
    allowed = q.constraint_report(_tables(spark), ["fk_orders_customer"], pks, fks)
    assert q.assert_constraints(allowed) == ["fk_orders_customer"]
    clean = q.constraint_report(_tables(spark, orphan=False), (), pks, fks)
    assert q.assert_constraints(clean) == []
