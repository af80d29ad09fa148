"""Mergeable quantile sketches: percentiles of any period without a rescan.

Exact percentiles (``quantiles``) read every value again for each question. A KLL
sketch holds a few thousand bytes per group and month, whatever the number of
rows; sketches of months merge into that of any period, and of states into that
of all. Percentiles read from them are values of the data whose rank is off by
about ``RANK_ERROR`` of the rows (with ``K``); counts, least and greatest values
are kept beside them and exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 800
RANK_ERROR = 0.01  # of the rows, in 99 of 100 sketches; 0.004 is usual at this K


def month_sketches(rows: DataFrame, keys: Sequence[str], time: str, measure: str, k: int = K) -> DataFrame:
    """``keys``, month (null where the time is), n_rows, n (values that are not
    null), low, high, sketch. ``measure`` is a whole number. Combines in the map
    tasks, so a key with a great part of all rows shuffles one sketch a task."""
    value = F.col(measure).cast("long")
    return rows.groupBy(*keys, F.trunc(F.col(time).cast("date"), "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.kll_sketch_agg_bigint(value, k).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = (), start: str | None = None, end: str | None = None, k: int = K) -> DataFrame:
    """The sketches of the months from ``start`` up to, not with, ``end``
    (dates; default: all, those without a time too), merged by ``keys``."""
    if start is not None:
        sketches = sketches.where(F.col("month") >= F.lit(start).cast("date"))
    if end is not None:
        sketches = sketches.where(F.col("month") < F.lit(end).cast("date"))
    merged = F.kll_merge_agg_bigint(F.when(F.col("n") > 0, F.col("sketch")), k).alias("sketch")
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("n_rows", "n")]
    return sketches.groupBy(*keys).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), merged)


def percentiles(sketches: DataFrame, requests: Mapping[str, int]) -> DataFrame:
    """Adds each requested percentile (name to whole percent); null where no
    value is there."""

    def at(percent: int) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(percent / 100)))

    return sketches.withColumns({name: at(percent) for name, percent in requests.items()})
