"""Snapshot commit: sets of tables that change all at once or not at all.

A folder holds versions. Tables are written to fresh folders of their own under
``data/``; a version is a small list of table names, paths and schemas under
``versions/<number>``. Committing renames that list to the next free number, in
one step that fails if the number is taken: readers see the old version or the
new one, a writer that dies leaves the old one, and of two writers from one
version the second gets ``ConflictError``. Files of a version are never written
again, so frames opened before a later commit go on reading.

The rename must be atomic and refuse an existing target, as on HDFS and local
disks. On object stores without such a rename, let one job publish at a time.
``expire`` frees the files of old versions when nobody reads them any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .buckets import Buckets, open_bucketed, write_bucketed


class ConflictError(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Entry:
    """One table of a version."""

    path: str
    schema: str
    buckets: dict | None = None

    def open(self, spark: SparkSession) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schema))
        if self.buckets:
            return open_bucketed(spark, self.path, schema, Buckets(**self.buckets))
        # The stored schema: partition columns keep their type and place.
        return spark.read.schema(schema).parquet(self.path).select(*schema.names)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that must be free; False if it is taken."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.getFileSystem(conf).makeQualified(old).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(old, new, options)
    except Exception as e:  # a Py4J error holds the Java one
        if context.util().exists(new):
            return False
        raise e
    return True


class Snapshots:
    """The versions under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = _hadoop(self.spark, f"{self.folder}/versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def entries(self, version: int | None = None) -> dict[str, Entry]:
        """Tables of a version (default: the latest; none before the first)."""
        known = self.versions()
        if version is None and not known:
            return {}
        version = known[-1] if version is None else version
        if version not in known:
            raise KeyError(f"{self.folder} has no version {version}")
        text = self.spark.read.text(f"{self.folder}/versions/{version:010d}/tables.json", wholetext=True).first()[0]
        return {name: Entry(**e) for name, e in json.loads(text).items()}

    def open(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: e.open(self.spark) for name, e in self.entries(version).items()}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.entries(version)[name].open(self.spark)

    def begin(self, keep: bool = True) -> Transaction:
        """A new version; with ``keep`` it takes over the latest one's other tables."""
        return Transaction(self, keep)

    def expire(self, last: int = 2) -> list[int]:
        """Forget all but the ``last`` versions and delete the tables that only
        they hold. Folders of no version (writers at work or dead) stay."""
        if last < 1:
            raise ValueError("the latest version cannot be expired")
        known = self.versions()
        old, kept = known[:-last], known[-last:]
        paths = {e.path for v in old for e in self.entries(v).values()} - {e.path for v in kept for e in self.entries(v).values()}
        for path in [*(f"{self.folder}/versions/{v:010d}" for v in old), *sorted(paths)]:
            fs, p = _hadoop(self.spark, path)
            fs.delete(p, True)
        return old


class Transaction:
    """Tables written so far; nobody sees them before ``commit``."""

    def __init__(self, of: Snapshots, keep: bool = True):
        self.of = of
        self.base = (of.versions() or [0])[-1]
        self.entries: dict[str, Entry] = of.entries(self.base) if keep and self.base else {}
        self.frames: dict[str, DataFrame] = {}
        self.data = f"{of.folder}/data/{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, partition_by: Sequence[str] = (), buckets: Buckets | None = None) -> DataFrame:
        """Write one table and return it read back."""
        from .tables import spread_for_partitions

        path, held = f"{self.data}/{name}", None
        if buckets is not None:
            held = write_bucketed(df, path, buckets)
        elif partition_by:
            spread_for_partitions(df, partition_by).write.partitionBy(*partition_by).parquet(path)
        else:
            df.write.parquet(path)
        entry = Entry(path, df.schema.json(), asdict(held) if held else None)
        self.entries[name], self.frames[name] = entry, entry.open(self.of.spark)
        return self.frames[name]

    def commit(self) -> int:
        """Make the tables the next version, or raise ``ConflictError``."""
        spark, number = self.of.spark, self.base + 1
        part = f"{self.data}/_version"
        fs, p = _hadoop(spark, f"{part}/tables.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({n: asdict(e) for n, e in sorted(self.entries.items())}).encode()))
        out.close()
        fs.mkdirs(_hadoop(spark, f"{self.of.folder}/versions")[1])
        if not rename_new(spark, part, f"{self.of.folder}/versions/{number:010d}"):
            raise ConflictError(f"version {number} of {self.of.folder} was committed by another writer")
        return number


__all__ = ["ConflictError", "Entry", "Snapshots", "Transaction", "rename_new"]
