"""Every registered query equals its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as E
from repurchase.oracle.compare import compare, duck

from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(name, E.queries()[name](spark, SMALL), E.oracle_sql()[name], con)
    assert r.ok, r.detail


def test_every_query_has_an_oracle():
    assert set(E._REGISTRY) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert len(df.columns) == 23
    assert df.count() > 0
