"""The constraint report reads each table once, and counts what the single
checks count."""

import re

import __spark_entry__ as E
from repurchase.operators import quality
from repurchase.operators.quality import ForeignKey, PrimaryKey

from conftest import SMALL


def test_each_table_is_scanned_once(spark):
    a = E._analysis(spark, SMALL)
    plan = a.constraint_report()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan parquet", plan)) == 11 and "Join" not in plan


def test_report_equals_the_single_checks(spark):
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (None, "d")], "k long, l string")
    child = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3), (5, None), (5, None)], "id long, k long")
    tables = {"parent": parent, "child": child, "empty": parent.where("false")}
    pks = [PrimaryKey("p", "parent", ("k",)), PrimaryKey("pl", "parent", ("k", "l")), PrimaryKey("c", "child", ("id",)), PrimaryKey("e", "empty", ("k",))]
    fks = [ForeignKey("f", "child", "k", "parent", "k"), ForeignKey("g", "child", "k", "empty", "k"), ForeignKey("h", "empty", "k", "parent", "k"), ForeignKey("own", "child", "id", "child", "k")]
    got = {r.constraint_name: (r.duplicate_keys, r.null_key_rows, r.orphan_rows, r.status) for r in quality.constraint_report(tables, ["g"], pks, fks).collect()}
    assert len(got) == len(pks) + len(fks)
    for pk in pks:
        want = (quality.pk_duplicates(tables[pk.table], pk.keys).count(), quality.pk_nulls(tables[pk.table], pk.keys).count(), 0)
        assert got[pk.name] == (*want, "fail" if any(want) else "pass"), pk
    for fk in fks:
        orphans = quality.fk_orphans(tables[fk.child], tables[fk.parent], fk.child_key, fk.parent_key, distinct=False).count()
        assert got[fk.name][:3] == (0, 0, orphans), fk
    assert got["g"][3] == "expected_failure" and got["e"] == (0, 0, 0, "pass")
