"""Share of total over already-aggregated rows (SUM(COUNT(*)) OVER ())."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numeric import pct


def with_share(df: DataFrame, count_col: str, out: str, dp: int = 2) -> DataFrame:
    """Add ``out`` = count_col / total(count_col) * 100, rounded half-up.

    Only call this on grouped rows (tiers, states, statuses): the empty
    window moves them to one partition, which is bounded by the number of
    groups, never by the data.
    """
    total = F.sum(F.col(count_col)).over(Window.partitionBy())
    return df.withColumn(out, pct(F.col(count_col), total, dp))


def tier(cases: list[tuple[Column, str]], default: str) -> Column:
    """Ordered CASE: the first matching condition's label, else ``default``."""
    expr = None
    for cond, label in cases:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
