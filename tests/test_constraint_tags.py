"""The constraint report's tags are short, and its tables dealt by order."""

import __spark_entry__ as E
from repurchase.operators import quality
from repurchase.operators.quality import ForeignKey, PrimaryKey

from conftest import SMALL


def test_payments_lie_in_the_order_buckets(spark):
    t = E._analysis(spark, SMALL).t
    plan = quality.pk_duplicates(t["order_payments"], ("order_id", "payment_sequential"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tags_hold_whole_keys_as_numbers_and_own_uses_only(spark):
    uses = quality.key_uses(E._analysis(spark, SMALL).t)
    assert uses.columns == ["domain", "number", "value", "has_null", "parents", "uses_0", "uses_1", "uses_2"]
    place = list(quality._domains(quality.PRIMARY_KEYS, quality.FOREIGN_KEYS)).index(("orders", ("order_id",)))
    assert uses.where(f"domain = {place} and value is not null").count() == 0


def test_report_counts_keys_of_any_type(spark):
    """Text, whole and mixed keys, null parts, separators within values, and a
    reference of another type than its key."""
    parent = spark.createDataFrame([(1, "a|b", 1), (1, "a|b", 1), (1, "a", 1), (2, None, 1), (2, None, 1), (None, "1", 1), (None, "<null>", 2)], "k int, l string, m long")
    child = spark.createDataFrame([("1", 1, 2.0), ("01", 2, 3.5), ("3", 3, None), (None, None, 2.0)], "s string, k long, d double")
    tables = {"parent": parent, "child": child}
    pks = [PrimaryKey("k", "parent", ("k",)), PrimaryKey("kl", "parent", ("k", "l")), PrimaryKey("lk", "parent", ("l", "k")), PrimaryKey("klm", "parent", ("k", "l", "m")), PrimaryKey("d", "child", ("d",))]
    fks = [ForeignKey("whole", "child", "k", "parent", "k"), ForeignKey("text", "child", "s", "parent", "l")]
    got = {r.constraint_name: (r.duplicate_keys, r.null_key_rows, r.orphan_rows) for r in quality.constraint_report(tables, [], pks, fks).collect()}
    for pk in pks:
        assert got[pk.name] == (quality.pk_duplicates(tables[pk.table], pk.keys).count(), quality.pk_nulls(tables[pk.table], pk.keys).count(), 0), pk
    for fk in fks:
        orphans = quality.fk_orphans(tables[fk.child], tables[fk.parent], fk.child_key, fk.parent_key, distinct=False).count()
        assert got[fk.name] == (0, 0, orphans), fk
