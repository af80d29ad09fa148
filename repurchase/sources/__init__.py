"""Sources and sinks: parquet load, table write, dimension back-fill, fixtures."""

from .fixtures import FixtureTables, fixture_tables, ingest_fixture_tables
from .buckets import Buckets, bucket_count
from .snapshots import ConflictError, Snapshots
from .tables import (
    REFERENCE_TABLES,
    REQUIRED_COLUMNS,
    backfill_dim,
    cast_losses,
    copy_tables,
    list_tables,
    load_tables,
    normalize_types,
    storage_root,
    table_inventory,
    write_table,
)

__all__ = [
    "Buckets",
    "ConflictError",
    "FixtureTables",
    "REFERENCE_TABLES",
    "REQUIRED_COLUMNS",
    "Snapshots",
    "backfill_dim",
    "bucket_count",
    "cast_losses",
    "copy_tables",
    "fixture_tables",
    "ingest_fixture_tables",
    "list_tables",
    "load_tables",
    "normalize_types",
    "storage_root",
    "table_inventory",
    "write_table",
]
