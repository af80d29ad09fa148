"""Stored cohort stages: the reference's ``CREATE TABLE step1/2/3 ... AS``.

Every report reads the same few stages (delivered orders, people, mature
people, their orders, the per-order base). Recomputing them per report
would repeat the same joins and shuffles dozens of times; instead each
stage is written once to the shared folder and read back. A stage is keyed
by the source snapshot, the parameters and the code version, and counts as
present only after its write committed (``_SUCCESS``). Reading files back also cuts lineage, so
a lost executor re-reads a file instead of recomputing the cohort.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.buckets import Buckets, open_bucketed, write_bucketed
from ..sources.snapshots import Transaction, rename_new
from ..sources.tables import spread_for_partitions


def code_fingerprint() -> str:
    """Hash of the source of every module that shapes a stored table, so a
    changed operator never reads stages written by an older version."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    h = hashlib.sha1()
    for sub in ("functions", "operators", "sources", "plans"):
        for f in sorted((root / sub).glob("*.py")):
            h.update(f.name.encode())
            h.update(f.read_bytes())
    return h.hexdigest()[:16]


_OPENED: dict[tuple[str, str], DataFrame] = {}
_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def path_lock(path: str) -> threading.Lock:
    """One lock per output path, so threads of one driver never write the
    same table twice at once (separate drivers should use separate roots)."""
    with _LOCKS_GUARD:
        return _LOCKS.setdefault(path, threading.Lock())


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return fs.exists(p)


_MARK = "_buckets.json"  # Spark reads no file whose name begins so


def publish_once(df: DataFrame, path: str, partition_by: str | None = None, buckets: Buckets | None = None) -> None:
    """Write under a name of its own and rename to ``path`` if that is still
    free: of several writers the first wins, and no reader sees half a table."""
    spark, part = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    if buckets is not None:
        held = write_bucketed(df, part, buckets)
        if held is not None:
            fs, mark = _fs_path(spark, f"{part}/{_MARK}")
            out = fs.create(mark, False)
            out.write(bytearray(json.dumps(asdict(held)).encode()))
            out.close()
    elif partition_by:
        spread_for_partitions(df, [partition_by]).write.partitionBy(partition_by).parquet(part)
    else:
        df.write.parquet(part)
    rename_new(spark, part, path)
    if not _exists(spark, f"{path}/_SUCCESS"):
        raise RuntimeError(f"{path} exists without having been committed")


def open_stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table written by ``publish_once``, with its buckets if it has any."""
    schema = schema or spark.read.parquet(path).schema
    if not _exists(spark, f"{path}/{_MARK}"):
        return spark.read.schema(schema).parquet(path)
    return open_bucketed(spark, path, schema, Buckets(**json.loads(_text(spark, f"{path}/{_MARK}"))))


def _text(spark: SparkSession, path: str) -> str:
    """A short file; Spark's readers pass over names that begin with ``_``."""
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class StageStore:
    """Stages under ``{root}/stages/{hash(key)}``."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark = spark
        digest = hashlib.sha1(f"{key}|{code_fingerprint()}".encode()).hexdigest()[:16]
        self.base = f"{root.rstrip('/')}/stages/{digest}"

    def get(self, name: str, build: Callable[[], DataFrame], partition_by: str | None = None, buckets: Buckets | None = None) -> DataFrame:
        path = f"{self.base}/{name}"
        # A committed stage never changes (its path encodes source, parameters
        # and code), so one opened frame serves the whole application.
        key = (self.spark.sparkContext.applicationId, path)
        with path_lock(path):
            if key not in _OPENED:
                schema = None
                if not _exists(self.spark, f"{path}/_SUCCESS"):
                    df = build()
                    schema = df.schema
                    publish_once(df, path, partition_by, buckets)
                _OPENED[key] = open_stored(self.spark, path, schema)
        return _OPENED[key]


class TransactionStore:
    """Stages written as tables of a snapshot that is not yet committed."""

    def __init__(self, transaction: Transaction):
        self.transaction = transaction

    def get(self, name: str, build: Callable[[], DataFrame], partition_by: str | None = None, buckets: Buckets | None = None) -> DataFrame:
        made = self.transaction.frames
        return made[name] if name in made else self.transaction.write(name, build(), [partition_by] if partition_by else (), buckets)
