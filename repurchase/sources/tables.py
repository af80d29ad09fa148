"""Load, write and back-fill tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from .buckets import Buckets
    from .snapshots import Transaction

# The eleven tables the analysis reads, in the order the key checks visit them.
REFERENCE_TABLES = (
    "orders",
    "order_items",
    "sellers",
    "customers",
    "leads_closed",
    "order_payments",
    "products",
    "product_category_name_translation",
    "order_reviews",
    "geolocation",
    "leads_qualified",
)


# Columns that some operator reads, by table.
REQUIRED_COLUMNS = {
    "orders": (
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
    ),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    "sellers": ("seller_id", "seller_state"),
    "customers": ("customer_id", "customer_unique_id", "customer_state"),
    "leads_closed": ("mql_id", "seller_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "products": ("product_id", "product_category_name"),
    "product_category_name_translation": ("product_category_name", "product_category_name_english"),
    "order_reviews": ("review_id", "order_id", "review_score"),
    "geolocation": ("geolocation_id",),
    "leads_qualified": ("mql_id",),
}


def list_tables(spark: SparkSession, directory: str) -> list[str]:
    """Names of the parquet tables in a folder, read through Hadoop's file
    system, so any store Spark reads will do."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def load_tables(
    spark: SparkSession,
    directory: str,
    names: Iterable[str],
    required_columns: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Read ``{directory}/{name}.parquet`` for every name, whole.

    Executors read the parquet splits; nothing passes through the driver.
    ``required_columns`` fails fast when a table lacks a column an operator
    will read, instead of failing deep inside a plan.
    """
    out: dict[str, DataFrame] = {}
    for name in names:
        df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
        missing = [c for c in (required_columns or {}).get(name, ()) if c not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks columns {missing}")
        out[name] = df
    return out


# Columns whose type the operators rely on: timestamps (often stored as
# text), money (often floating point) and review scores.
TIMESTAMP_COLUMNS = {
    "orders": ("order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date"),
}
MONEY_COLUMNS = {"order_items": ("price", "freight_value")}
INTEGER_COLUMNS = {"order_reviews": ("review_score",), "order_items": ("order_item_id",)}


def normalize_types(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Give the columns the operators compute with their working types.

    Text timestamps become ``timestamp_ntz`` with ``try_cast`` (dirty text
    becomes null instead of failing the job, as a missing date); floating
    money becomes ``decimal(12,2)`` once, before any sum, so totals do not
    depend on summation order; scores and item numbers become integers.
    Columns already of the right type are left alone.
    """
    out = dict(tables)
    for name, df in tables.items():
        casts = {}
        for c in TIMESTAMP_COLUMNS.get(name, ()):
            if c in df.columns and df.schema[c].dataType.simpleString() != "timestamp_ntz":
                casts[c] = F.col(c).try_cast("timestamp_ntz")
        for c in MONEY_COLUMNS.get(name, ()):
            if c in df.columns and df.schema[c].dataType.simpleString() != "decimal(12,2)":
                casts[c] = F.col(c).cast("decimal(12,2)")
        for c in INTEGER_COLUMNS.get(name, ()):
            if c in df.columns and df.schema[c].dataType.simpleString() not in ("int", "bigint"):
                casts[c] = F.col(c).try_cast("int")
        if casts:
            out[name] = df.withColumns(casts)
    return out


def cast_losses(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """Per column that ``normalize_types`` cast: values that were there before
    and are null after, as dirty text is. Each table is read once."""
    parts = []
    for name, df in before.items():
        old, new = dict(df.dtypes), dict(after[name].dtypes)
        cast = [c for c in old if old[c] != new.get(c, old[c])]
        if cast:
            lost = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(new[c]).isNull()).alias(c) for c in cast]
            rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("lost_values")) for c in cast]))
            parts.append(df.agg(*lost).select(F.lit(name).alias("table_name"), rows.alias("r")).select("table_name", "r.*"))
    if not parts:
        spark = next(iter(before.values())).sparkSession
        return spark.createDataFrame([], "table_name string, column_name string, lost_values long")
    return reduce(DataFrame.unionByName, parts)


def copy_tables(raw: Mapping[str, DataFrame], run: Transaction, buckets: Mapping[str, Buckets] | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str | None, int]]]:
    """Copy tables with their working types into a snapshot (S1), and count on
    the way: each table is read once.

    Returns the copies and the load report: (table, null, rows) and, for each
    column that was cast, (table, column, values that were there and are null
    after, as dirty text is). Counts are observed in the tasks that write. The
    caller commits ``run``.
    """
    copies, report = {}, []
    tidy = normalize_types(raw)
    for name, df in raw.items():
        old, new = dict(df.dtypes), dict(tidy[name].dtypes)
        cast = [c for c in old if old[c] != new.get(c, old[c])]
        lost = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(new[c]).isNull()).alias(f"lost_{i}") for i, c in enumerate(cast)]
        seen = Observation()
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), *lost)
        copies[name] = run.write(name, normalize_types({name: watched})[name], buckets=(buckets or {}).get(name))
        counts = seen.get
        report.append((name, None, counts["n"]))
        report += [(name, c, counts[f"lost_{i}"]) for i, c in enumerate(cast)]
    return copies, report


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name and row count (the load report of S1)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def storage_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables and checkpoints.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Only a local-mode session without one gets a private folder; a cluster
    session without a shared folder is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="repurchase-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def spread_for_partitions(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows gathered by partition value, ready to be written by it: Spark
    splits a value with much data over as many tasks as its size asks for, and
    joins small ones, at run time (``advisoryPartitionSizeInBytes``)."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] | None = None,
    mode: str = "overwrite",
) -> DataFrame:
    """Materialise a derived table as parquet at ``path`` and return it read
    back (S2).

    Replaces the table like ``CREATE TABLE ... AS`` after a drop, under running
    readers too; tables that must change without anyone noticing, alone or
    together, go through ``snapshots``. Reading it back cuts the lineage, so
    later stages and retries start from the files.
    """
    if partition_by:
        df = spread_for_partitions(df, partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # Read back with the written schema: partition columns keep their type
    # instead of being re-inferred from directory names.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def backfill_dim(dim: DataFrame, rows: Sequence[tuple], key: Sequence[str] | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Append literal dimension rows whose key is not present yet (S3).

    ``columns`` names the values of a row, in their order (default: the
    dimension's). Idempotent: running it twice adds nothing the second time.
    ``rows`` is a short literal list, so it is small by construction.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(columns or dim.columns)
    spark = dim.sparkSession
    schema = StructType([dim.schema[c] for c in names])
    extra = spark.createDataFrame(list(rows), schema=schema)
    new = extra.join(dim.select(*keys), on=keys, how="left_anti").dropDuplicates(keys)
    return dim.unionByName(new, allowMissingColumns=True)
