"""Key and reference checks and the publishing gate (V1-V5).

Spark does not enforce keys, and refuses ``ALTER TABLE ... ADD CONSTRAINT``
on parquet tables, so constraints are data: a declarative list checked by
aggregates and anti joins into one report, and a gate that stops publishing
when a constraint fails that is not on the allow list.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PrimaryKey:
    name: str
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    name: str
    child: str
    child_key: str
    parent: str
    parent_key: str
    distinct: bool = True
    exclude_null: bool = True


# The analysis' keys, in the order it checks them.
PRIMARY_KEYS = (
    PrimaryKey("pk_orders", "orders", ("order_id",)),
    PrimaryKey("pk_order_items", "order_items", ("order_id", "order_item_id")),
    PrimaryKey("pk_sellers", "sellers", ("seller_id",)),
    PrimaryKey("pk_customers", "customers", ("customer_id",)),
    PrimaryKey("pk_leads_closed", "leads_closed", ("mql_id",)),
    PrimaryKey("pk_order_payments", "order_payments", ("order_id", "payment_sequential")),
    PrimaryKey("pk_products", "products", ("product_id",)),
    PrimaryKey("pk_product_category_name_translation", "product_category_name_translation", ("product_category_name",)),
    PrimaryKey("pk_order_reviews", "order_reviews", ("review_id", "order_id")),
    PrimaryKey("pk_geolocation", "geolocation", ("geolocation_id",)),
    PrimaryKey("pk_leads_qualified", "leads_qualified", ("mql_id",)),
)

FOREIGN_KEYS = (
    ForeignKey("fk_orders_customer_id", "orders", "customer_id", "customers", "customer_id", False, False),
    ForeignKey("fk_order_payments_order_id", "order_payments", "order_id", "orders", "order_id", False, False),
    ForeignKey(
        "fk_products_product_category_name",
        "products",
        "product_category_name",
        "product_category_name_translation",
        "product_category_name",
    ),
    ForeignKey("fk_order_reviews_order_id", "order_reviews", "order_id", "orders", "order_id"),
    ForeignKey("fk_order_items_order_id", "order_items", "order_id", "orders", "order_id"),
    ForeignKey("fk_order_items_product_id", "order_items", "product_id", "products", "product_id"),
    ForeignKey("fk_order_items_seller_id", "order_items", "seller_id", "sellers", "seller_id"),
    ForeignKey("fk_leads_closed_mql_id", "leads_closed", "mql_id", "leads_qualified", "mql_id"),
    ForeignKey("fk_leads_closed_seller_id", "leads_closed", "seller_id", "sellers", "seller_id"),
)


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def pk_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V1: key values occurring more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count_num")).where(F.col("count_num") > 1)


def pk_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V2: rows with a null in any key column."""
    return df.where(_any_null(keys))


def fk_orphans(
    child: DataFrame,
    parent: DataFrame,
    child_key: str,
    parent_key: str,
    distinct: bool = True,
    exclude_null: bool = True,
) -> DataFrame:
    """V3: child key values without a parent row (LEFT JOIN ... IS NULL).

    A null child key never matches, so it is an orphan unless
    ``exclude_null``; ``distinct`` reports each value once.
    """
    c = child.select(F.col(child_key).alias(child_key))
    if exclude_null:
        c = c.where(F.col(child_key).isNotNull())
    p = parent.select(F.col(parent_key).alias("_parent_key"))
    out = c.join(p, c[child_key] == p["_parent_key"], "left_anti")
    return out.distinct() if distinct else out


def fk_orphan_summary(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """V4: unmatched child rows and distinct unmatched keys (nulls excluded)."""
    o = fk_orphans(child, parent, child_key, parent_key, distinct=False, exclude_null=True)
    return o.agg(
        F.count(F.lit(1)).alias("unmatched_rows"), F.countDistinct(child_key).alias("unmatched_key_count")
    )


def _key_text(keys: Sequence[str]) -> Column:
    """Key as one text that no other key has: parts are joined by ``|``, a
    null part reads ``<null>``, and a backslash stands before each backslash,
    ``|`` and ``<`` of a value."""
    parts = [F.regexp_replace(F.col(k).cast("string"), r"([\\|<])", r"\\$1") for k in keys]
    return F.concat_ws("|", *[F.coalesce(x, F.lit("<null>")) for x in parts])


def pk_duplicate_report(tables: Mapping[str, DataFrame], pks: Iterable[PrimaryKey] = PRIMARY_KEYS) -> DataFrame:
    """V1 over every primary key: constraint, key text, count."""
    parts = [
        pk_duplicates(tables[pk.table], pk.keys).select(
            F.lit(pk.name).alias("constraint_name"), _key_text(pk.keys).alias("key_value"), "count_num"
        )
        for pk in pks
    ]
    return reduce(DataFrame.unionByName, parts)


def pk_null_report(tables: Mapping[str, DataFrame], pks: Iterable[PrimaryKey] = PRIMARY_KEYS) -> DataFrame:
    """V2 over every primary key: constraint and number of null-key rows."""
    parts = [
        tables[pk.table].agg(F.count_if(_any_null(pk.keys)).alias("null_key_rows")).select(
            F.lit(pk.name).alias("constraint_name"), "null_key_rows"
        )
        for pk in pks
    ]
    return reduce(DataFrame.unionByName, parts)


def pk_null_rows(tables: Mapping[str, DataFrame], pks: Iterable[PrimaryKey] = PRIMARY_KEYS) -> DataFrame:
    """V2 as rows: constraint and key text of every row with a null key part."""
    parts = [
        pk_nulls(tables[pk.table], pk.keys).select(F.lit(pk.name).alias("constraint_name"), _key_text(pk.keys).alias("key_value"))
        for pk in pks
    ]
    return reduce(DataFrame.unionByName, parts)


def fk_orphan_report(tables: Mapping[str, DataFrame], fks: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """V3 over every foreign key: constraint and orphan key (as text)."""
    parts = [
        fk_orphans(
            tables[fk.child], tables[fk.parent], fk.child_key, fk.parent_key, fk.distinct, fk.exclude_null
        ).select(F.lit(fk.name).alias("constraint_name"), F.col(fk.child_key).cast("string").alias("orphan_key"))
        for fk in fks
    ]
    return reduce(DataFrame.unionByName, parts)


def fk_summary_report(tables: Mapping[str, DataFrame], fks: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """V4 over every foreign key."""
    parts = [
        fk_orphan_summary(tables[fk.child], tables[fk.parent], fk.child_key, fk.parent_key).select(
            F.lit(fk.name).alias("constraint_name"), "unmatched_rows", "unmatched_key_count"
        )
        for fk in fks
    ]
    return reduce(DataFrame.unionByName, parts)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _domains(pks: Iterable[PrimaryKey], fks: Iterable[ForeignKey]) -> dict[tuple[str, tuple[str, ...]], list[int]]:
    """The referenced keys (table, columns), each with the places of the
    foreign keys that refer to it."""
    out: dict[tuple[str, tuple[str, ...]], list[int]] = {(pk.table, pk.keys): [] for pk in pks}
    for i, fk in enumerate(fks):
        out.setdefault((fk.parent, (fk.parent_key,)), []).append(i)
    return out


def key_uses(tables: Mapping[str, DataFrame], pks: Iterable[PrimaryKey] = PRIMARY_KEYS, fks: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """How often each key value occurs: domain (place of the referenced key
    among ``_domains``), number and value (the key), has_null, parents (rows that
    hold it as their key), uses_<i> (rows that refer to it by the i-th foreign
    key of its domain).

    A table is read once: each row gives one tag for each constraint that looks
    at it, and tags are counted before the only shuffle, so a value with a great
    part of all rows is one row per task. Most keys of a primary key occur once,
    so that counting holds and shuffles nearly every tag: a tag is short. A first
    key column of whole numbers on every side is ``number``, other columns are
    the text ``value``, and a domain counts its own foreign keys only.
    """
    pks, fks = list(pks), list(fks)
    tags: dict[str, list[Column]] = {}
    types = {table: dict(tables[table].dtypes) for table in {*(pk.table for pk in pks), *(fk.child for fk in fks), *(fk.parent for fk in fks)}}
    domains = _domains(pks, fks)

    def tag(table: str, domain: int, keys: Sequence[str], whole: bool, role: int) -> None:
        number = F.col(keys[0]).cast("long") if whole else F.lit(None).cast("long")
        rest = keys[1:] if whole else keys
        value = _key_text(rest) if len(rest) > 1 else F.col(rest[0]).cast("string") if rest else F.lit(None).cast("string")
        one = F.struct(F.lit(domain).alias("domain"), number.alias("number"), value.alias("value"), _any_null(keys).alias("has_null"), F.lit(role).alias("role"))
        tags.setdefault(table, []).append(one)

    for domain, ((table, keys), users) in enumerate(domains.items()):
        sides = [(table, keys), *((fks[i].child, (fks[i].child_key,)) for i in users)]
        whole = all(types[t][k[0]] in _WHOLE for t, k in sides)
        for role, (side, columns) in enumerate(sides, -1):
            tag(side, domain, columns, whole, role)
    rows = [tables[table].select(F.inline(F.array(*own))) for table, own in tags.items()]
    counts = [F.count_if(F.col("role") == -1).alias("parents"), *(F.count_if(F.col("role") == i).alias(f"uses_{i}") for i in range(max(map(len, domains.values()))))]
    return reduce(DataFrame.union, rows).groupBy("domain", "number", "value", "has_null").agg(*counts)


def constraint_report(
    tables: Mapping[str, DataFrame],
    expected_failures: Iterable[str] = (),
    pks: Iterable[PrimaryKey] = PRIMARY_KEYS,
    fks: Iterable[ForeignKey] = FOREIGN_KEYS,
) -> DataFrame:
    """V5: one row per constraint with its violations and status.

    A primary key is violated by duplicate key values and null key parts; a
    foreign key by non-null child values without a parent (null references
    pass, as in SQL). Status is ``pass``, ``expected_failure`` (allow-listed,
    e.g. a reference left unenforced) or ``fail``. Each table is scanned once,
    whatever the number of its constraints (``key_uses``).
    """
    allowed, pks, fks = list(expected_failures), list(pks), list(fks)
    domains = _domains(pks, fks)
    place = {domain: i for i, domain in enumerate(domains)}
    uses = key_uses(tables, pks, fks)
    zero = F.lit(0).cast("long")
    nulls = F.coalesce(F.sum(F.when(F.col("has_null"), F.col("parents"))), zero).alias("_nulls")
    orphan = (F.col("parents") == 0) & ~F.col("has_null")
    orphans = [F.coalesce(F.sum(F.when(orphan, F.col(f"uses_{i}"))), zero).alias(f"_orphans_{i}") for i in range(max(map(len, domains.values())))]
    # One row per domain of keys, then one per constraint that looks at it.
    found = uses.groupBy("domain").agg(F.count_if(F.col("parents") > 1).alias("_duplicates"), nulls, *orphans)
    row = lambda c, kind, domain, d, n, o: F.struct(
        F.lit(c.name).alias("constraint_name"),
        F.lit(kind).alias("constraint_type"),
        F.lit(c.table if kind == "PRIMARY KEY" else c.child).alias("table_name"),
        F.lit(domain).alias("_of"),
        d.alias("duplicate_keys"),
        n.alias("null_key_rows"),
        o.alias("orphan_rows"),
    )
    rows = [row(pk, "PRIMARY KEY", place[pk.table, pk.keys], F.col("_duplicates"), F.col("_nulls"), zero) for pk in pks]
    for domain, users in domains.items():
        rows += [row(fks[i], "FOREIGN KEY", place[domain], zero, zero, F.col(f"_orphans_{role}")) for role, i in enumerate(users)]
    cols = ["constraint_name", "constraint_type", "table_name", "duplicate_keys", "null_key_rows", "orphan_rows"]
    # A domain of empty tables has no row: every constraint is listed anyway.
    none = next(iter(tables.values())).sparkSession.range(1).select(*[zero.alias(c) for c in found.columns[1:]])
    every = found.unionByName(none, allowMissingColumns=True).withColumn("_c", F.explode(F.array(*rows))).select("domain", "_c.*")
    own = every.where(F.col("domain").isNull() | (F.col("domain") == F.col("_of")))
    rep = own.groupBy(*cols[:3]).agg(*[F.sum(c).alias(c) for c in cols[3:]])
    allow = ", ".join(_sql_str(a) for a in allowed) or "NULL"
    return rep.selectExpr(
        *cols,
        "duplicate_keys + null_key_rows + orphan_rows AS violations",
        "CASE WHEN duplicate_keys + null_key_rows + orphan_rows = 0 THEN 'pass' "
        f"WHEN constraint_name IN ({allow}) THEN 'expected_failure' ELSE 'fail' END AS status",
    )


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class ConstraintError(RuntimeError):
    pass


def assert_constraints(report: DataFrame) -> list[str]:
    """Gate: raise if any constraint failed unexpectedly.

    The report has one row per declared constraint, so only that bounded
    list reaches the driver. Returns the allow-listed failures.
    """
    rows = report.select("constraint_name", "violations", "status").collect()
    failed = [f"{r.constraint_name} ({r.violations})" for r in rows if r.status == "fail"]
    if failed:
        raise ConstraintError("constraints failed: " + ", ".join(failed))
    return [r.constraint_name for r in rows if r.status == "expected_failure"]
