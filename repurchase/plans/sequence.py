"""LEAD over a group without bringing a whole group into one task.

``LEAD(x) OVER (PARTITION BY g ORDER BY t, ...)`` in Spark puts every row of a
group in one task; one person holding a third of all orders would make that
task a third of the job. Here a group is cut by a bucket of its order columns,
which is an expression of the row, so every branch of the plan agrees on it: a
day of a time column, a run of numbers, or, for text and any other type, a run
between quantile bounds taken from the rows (``plans.ranges``). Inside a bucket the successor is the
next row; the last row of a bucket continues with the first row of the group's
next bucket. Those first rows are one per group and bucket, so even a hot
group brings only its number of buckets into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranges import Bounds, bucket_of, range_bounds

HAS_NEXT = "_has_next"
_BUCKET, _FIRST, _B = "_lead_bucket", "_lead_first", "_lead_b_"


def _sort_key(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def default_bucket(df: DataFrame, order: Sequence[str]) -> Column:
    """Days of a time column, runs of 1000 of a numeric one, and quantiles of
    any other; it never falls where the order columns grow, and a day or a run
    is null where its column is. Only quantiles look at the rows (two jobs)."""
    column, kind = order[0], df.schema[order[0]].dataType
    if kind.simpleString().startswith("timestamp") or kind.simpleString() == "date":
        return F.date_trunc("DAY", F.col(column))
    if isinstance(kind, NumericType):
        return F.floor(F.col(column) / 1000)
    return bucket_of(df, order, range_bounds(df, order))


def next_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    bucket: Column | None = None,
    prefix: str = "next_",
    bounds: Bounds | None = None,
) -> DataFrame:
    """Add ``{prefix}{c}`` = LEAD(c) OVER (PARTITION BY keys ORDER BY order).

    ``order`` is ascending with nulls last (PostgreSQL's default); include a
    unique tiebreak column to make the successor deterministic. Also adds
    ``_has_next`` (a successor row exists, even when its values are null).
    ``bucket`` must not fall where the order columns grow; ``bounds`` (from
    ``range_bounds`` over the same order columns) cut a group that has most of
    its rows on one day, too. Text times (ISO 8601 sorts as text) need no cast.
    A null key is a group of its own; all columns of ``df`` are kept.
    """
    keys, order, carry = list(keys), list(order), list(carry)
    if bounds is not None:
        bucket = bucket_of(df, order, bounds)
    elif bucket is None:
        bucket = default_bucket(df, order)
    rows = df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*_sort_key(order))
    payload = F.struct(*[F.col(c).alias(c) for c in carry])
    within = rows.withColumn(_FIRST, F.lead(payload).over(inside))

    key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    heads = rows.groupBy(*keys, _BUCKET).agg(F.min_by(payload, key).alias(_FIRST))
    after = F.lead(_FIRST).over(Window.partitionBy(*keys).orderBy(F.col(_BUCKET).asc_nulls_last()))
    heads = heads.select(*[F.col(k).alias(f"{_B}{k}") for k in [*keys, _BUCKET]], after.alias(f"{_B}next"))

    same = [F.col(k).eqNullSafe(F.col(f"{_B}{k}")) for k in [*keys, _BUCKET]]
    joined = within.join(heads, on=same, how="inner")
    found = F.coalesce(F.col(_FIRST), F.col(f"{_B}next"))
    return joined.select(
        *[F.col(c) for c in df.columns],
        found.isNotNull().alias(HAS_NEXT),
        *[found[c].alias(f"{prefix}{c}") for c in carry],
    )
