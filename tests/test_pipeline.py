"""The publishing path: gate first, then stages and marts as files."""

import tempfile

import pytest

from repurchase.operators.quality import ConstraintError
from repurchase.plans.params import FIXTURE, REFERENCE
from repurchase.plans.pipeline import STAGES, publish
from repurchase.sources import ingest_fixture_tables, write_table

from conftest import SMALL


def test_gate_stops_publishing_on_unexpected_failure(spark):
    tables = ingest_fixture_tables(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="publish-")
    # The fixture's duplicate item keys are not allow-listed under the
    # reference parameters, so nothing may be written.
    with pytest.raises(ConstraintError, match="pk_order_items"):
        publish(tables, REFERENCE, folder)


def test_publish_writes_stages_and_marts(spark):
    tables = ingest_fixture_tables(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="publish-")
    out = publish(tables, FIXTURE, folder)
    for name in STAGES:
        assert name in out
    m1 = out["dm_state_logistics_retention_summary"]
    assert m1.count() == 8 and len(m1.columns) == 23
    fact = out["fact_customer_order_totals"]
    assert fact.schema["buyer_state"].dataType.simpleString() == "string"
    assert fact.count() > 0


def test_write_table_replaces(spark):
    folder = tempfile.mkdtemp(prefix="write-")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    write_table(df, f"{folder}/t")
    again = write_table(spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string"), f"{folder}/t")
    assert sorted(r.k for r in again.collect()) == [2, 3]


def test_republishing_rebuilds_stages(spark):
    from repurchase.plans.params import FIXTURE
    from dataclasses import replace

    tables = ingest_fixture_tables(spark, SMALL)
    folder = tempfile.mkdtemp(prefix="publish-")
    first = publish(tables, FIXTURE, folder)["mature"].count()
    later = replace(FIXTURE, maturity_cutoff="1995-06-01 00:00:00")
    second = publish(tables, later, folder)["mature"].count()
    assert second < first  # the earlier cohort was not reused
