"""Range bounds as data: quantiles of a sort key, taken from the rows.

A sort key may be text, a time, a number, or several columns. Its bounds are
weighted quantiles of a sample drawn by hash, so every run over the same rows
gives the same bounds; equal keys fall into the sample together and count as one
row with their number as weight. ``bucket_of`` says how many bounds a row's key
has reached: an expression of the row that never falls where the key grows, so
rows can be cut into sorted runs by it wherever they are, and every branch of a
plan agrees. Bounds are compared with, not subtracted: any spread of values,
types without arithmetic and nulls (last) are fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256
PER_PART = 64

Bounds = list[tuple]


def range_bounds(df: DataFrame, order: Sequence[str], parts: int = PARTS, per_part: int = PER_PART) -> Bounds:
    """At most ``parts`` - 1 keys, in rising order (nulls last), that cut the
    rows of ``df`` into runs of about equal length.

    One scan counts the rows, one more takes the sample: some ``parts`` *
    ``per_part`` keys, whatever the input's size, which one task sorts. The
    driver receives the bounds alone. An empty table has none. A key that holds
    more than a part's share of the rows is a run of its own.
    """
    order = list(order)
    total = df.agg(F.count(F.lit(1))).first()[0]
    every = max(1, total // (parts * per_part))
    keys = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    names = keys.columns
    drawn = keys.where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0)
    drawn = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("_w"))
    sort = [F.col(c).asc_nulls_last() for c in names]
    upto = F.sum("_w").over(Window.orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = drawn.withColumn("_upto", upto).withColumn("_all", F.sum("_w").over(Window.partitionBy()))
    # The run in which a key begins; the first key of each run but the first is a bound.
    run = F.floor((F.col("_upto") - F.col("_w")) * parts / F.col("_all"))
    first = F.min(F.struct("_upto", *names)).alias("_first")
    rows = ranked.groupBy(run.alias("_run")).agg(first).where("_run > 0").orderBy("_run").select("_first.*").collect()
    return [tuple(r[c] for c in names) for r in rows]


def _key(values: Sequence[Column]) -> Column:
    """A key that sorts nulls last."""
    return F.struct(*[x for i, v in enumerate(values) for x in (v.isNull().alias(f"n{i}"), v.alias(f"v{i}"))])


def bucket_of(df: DataFrame, order: Sequence[str], bounds: Bounds) -> Column:
    """How many of ``bounds`` the row's key has reached (0 to their number),
    found by halving: eight comparisons for 256 parts. Plain conditions without
    lambdas, so that branches of a plan which share it share their shuffle."""
    types = [df.schema[c].dataType for c in order]
    own = _key([F.col(c) for c in order])

    def reached(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = _key([F.lit(v).cast(t) for v, t in zip(bounds[mid], types, strict=True)])
        return F.when(own < bound, reached(lo, mid)).otherwise(reached(mid + 1, hi))

    return reached(0, len(bounds))
