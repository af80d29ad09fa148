"""Bucketed tables: stored by the hash of a key, joined without a shuffle.

Two tables in the same buckets of a key are joined, and either is grouped, by
that key where its files lie. Buckets are catalogue metadata in Spark, so a table
is registered in the session's catalogue, under a name made from its path, when
it is opened; ``Buckets`` is what has to be remembered about it (see
``snapshots``).

A bucket is written and read by one task. If one bucket would hold more than
``UNEVEN`` times the mean (a key with a great part of all rows), the table is
stored plainly and its joins shuffle, where Spark splits such keys at run time.
That check scans the key column once, and is left out where the key is unique.
A task sorts its bucket, and joins and groups hold it several times over, so a
bucket is small: its decoded rows, not its file, decide a task's memory.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET_BYTES = 16 << 20
LEAST, MOST = 8, 1 << 16
UNEVEN = 4
FEW = 10_000  # rows of a bucket that are no burden to a task


@dataclass(frozen=True)
class Buckets:
    """``count`` buckets by the hash of ``column``, sorted by it; ``unique``
    says that no value of it repeats."""

    column: str
    count: int
    unique: bool = False


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """A power of two (so tables of different sizes still fit each other), of
    buckets of about ``bucket_bytes``."""
    wanted = max(LEAST, min(MOST, -(-n_bytes // bucket_bytes)))
    return 1 << (wanted - 1).bit_length()


def evenly_dealt(df: DataFrame, buckets: Buckets) -> bool:
    """Whether no bucket holds much more than its share of the rows."""
    held = df.groupBy(F.pmod(F.hash(buckets.column), F.lit(buckets.count)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    return most is None or most <= max(FEW, UNEVEN * total / buckets.count)


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha1(path.encode()).hexdigest()[:24]}"


def write_bucketed(df: DataFrame, path: str, buckets: Buckets) -> Buckets | None:
    """Write ``df`` to ``path``, one file a bucket; None if its keys are too
    uneven and it was written plainly."""
    if not buckets.unique and not evenly_dealt(df, buckets):
        df.write.parquet(path)
        return None
    spark, name = df.sparkSession, f"writing_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets.count, buckets.column)
    dealt.write.format("parquet").bucketBy(buckets.count, buckets.column).sortBy(buckets.column).option("path", path).saveAsTable(name)
    # The table is external: its files stay, and are opened under a name of
    # their path, which may have changed by a rename.
    spark.sql(f"DROP TABLE {name}")
    return buckets


def open_bucketed(spark: SparkSession, path: str, schema: StructType, buckets: Buckets) -> DataFrame:
    """The table at ``path``, known to the catalogue with its buckets."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (`{buckets.column}`) SORTED BY (`{buckets.column}`) INTO {buckets.count} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of a frame's size; that of its files for a stored table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


__all__ = ["Buckets", "bucket_count", "evenly_dealt", "open_bucketed", "plan_bytes", "write_bucketed"]
