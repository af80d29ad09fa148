"""Plan shape checks: anti joins, no Python UDFs, pushdown and pruning."""

import __spark_entry__ as E

from conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_orphan_checks_use_anti_joins(spark):
    for name in ("V3_fk_orphans", "L3_orders_without_items"):
        p = plan(E.queries()[name](spark, SMALL))
        assert "LeftAnti" in p, name


def test_no_python_and_no_cross_join_anywhere(spark):
    for name, fn in {n: E.queries()[n] for n in E._REGISTRY}.items():
        p = plan(fn(spark, SMALL))
        for op in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas"):
            assert op not in p, (name, op)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan(E.queries()["E2_delivered_range"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)" in p or "EqualTo(order_status,delivered)" in p
    assert "ReadSchema: struct<order_status:string,order_purchase_timestamp:timestamp_ntz>" in p
