"""The command-line workflow over tables stored under the analysis' names."""

import os
import tempfile

from repurchase.__main__ import main
from repurchase.plans.params import FIXTURE
from repurchase.plans.pipeline import open_published
from repurchase.sources import ingest_fixture_tables

from conftest import SMALL


def test_cli_runs_the_workflow(spark):
    tables = ingest_fixture_tables(spark, SMALL)
    src = tempfile.mkdtemp(prefix="cli-in-")
    for name in tables:
        tables[name].write.parquet(f"{src}/{name}.parquet")
    out = tempfile.mkdtemp(prefix="cli-out-")
    # The fixture's known key failures are allowed only with fixture values;
    # the reference's allow list must stop the run before anything is written.
    import pytest

    from repurchase.operators.quality import ConstraintError

    with pytest.raises(ConstraintError):
        main(["--tables", src, "--out", out, "--cutoff", FIXTURE.maturity_cutoff, "--state", "S7"])
    assert not os.path.exists(f"{out}/published/dm_state_logistics_retention_summary")
    assert open_published(spark, f"{out}/published") == {}


def test_cli_publishes_and_writes_reports_when_failures_are_allowed(spark):
    tables = ingest_fixture_tables(spark, SMALL)
    src = tempfile.mkdtemp(prefix="cli-in-")
    for name in tables:
        tables[name].write.parquet(f"{src}/{name}.parquet")
    out = tempfile.mkdtemp(prefix="cli-out-")
    allow = "pk_order_items,pk_order_payments,fk_leads_closed_mql_id,fk_products_product_category_name"
    main(["--tables", src, "--out", out, "--cutoff", FIXTURE.maturity_cutoff, "--state", "S7", "--allow", allow])
    m1 = open_published(spark, f"{out}/published")["dm_state_logistics_retention_summary"]
    assert m1.count() == 8
    reports = sorted(os.listdir(f"{out}/reports"))
    assert "E9_repurchase_intervals" in reports and "M6_top_categories" in reports and len(reports) == 37
