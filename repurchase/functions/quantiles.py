"""Exact, distributed PERCENTILE_CONT over integral measures.

PostgreSQL's PERCENTILE_CONT(p) interpolates linearly between the values at
0-based ranks floor(p*(n-1)) and ceil(p*(n-1)). With p given in whole
percent and integral values (cents, microseconds) the interpolated value
times 100 is an integer:

    X = lo*100 + (hi - lo) * ((p*(n-1)) mod 100)

so the rounded result is exact and engine-independent.

Plan: explode the measures into (keys, measure, value) rows, count equal
values with a partial (map-side) aggregate, then rank the *distinct* values
per (keys, measure) with a distributed running sum (``running_counts``).
Neither a hot group's rows nor its distinct values ever meet in one task.
All requested percentiles of one frame share one pipeline.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"


def value_bucket(value: str) -> Column:
    """Bucket that never falls where the value grows: 1/256 of an octave of
    its distance from zero. A group has some 30,000 at most, whatever its
    number of values."""
    v = F.col(value)
    octave = F.log2(F.abs(v.cast("double")) + F.lit(1.0)) * F.lit(256.0)
    return F.when(v < 0, -F.ceil(octave)).otherwise(F.floor(octave)).cast("long")


def running_counts(counts: DataFrame, group: list[str], value: str, count: str) -> DataFrame:
    """Add ``_end`` (running sum of ``count`` by ascending ``value`` within
    ``group``) and ``_n`` (group total), without putting a group in one task.

    A group is cut into buckets of its values. Each bucket takes running sums
    of its own; the totals of a group's buckets, a bounded number of rows,
    give each the count of all earlier ones.
    """
    rows = counts.withColumn("_bucket", value_bucket(value))
    within = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_local_end", F.sum(count).over(within))
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(count).alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_o{c}") for c in [*group, "_bucket"]],
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_t").over(Window.partitionBy(*group)).alias("_n"),
    )
    # Null-safe on the group columns: a null key is a group of its own.
    cond = [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in [*group, "_bucket"]]
    joined = local.join(offsets, on=cond, how="inner").drop(*[f"_o{c}" for c in [*group, "_bucket"]])
    return joined.withColumn("_end", F.col("_off") + F.col("_local_end")).drop("_bucket", "_local_end", "_off")


def value_counts(df: DataFrame, keys: list[str], measures: Mapping[str, str | Column]) -> DataFrame:
    """(keys, _m, _v, _c): how often each non-null value of each measure
    occurs; ``_m`` numbers the measures. Equal values meet map-side."""
    packed = F.array(
        *[
            F.struct(F.lit(i).alias("m"), (F.expr(e) if isinstance(e, str) else e).cast("long").alias("v"))
            for i, e in enumerate(measures.values())
        ]
    )
    tall = df.select(*keys, F.explode(packed).alias("_mv")).select(*keys, F.col("_mv.m").alias("_m"), F.col("_mv.v").alias("_v"))
    return tall.where("_v IS NOT NULL").groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_c"))


def percentiles_of_counts(
    counts: DataFrame, keys: list[str], measures: Sequence[str], requests: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Percentile numerators (see ``percentile_numerators``) of counted
    values, one row per (keys, _m, _v)."""
    ranked = running_counts(counts, [*keys, "_m"], "_v", "_c")
    ids = {name: i for i, name in enumerate(measures)}
    aggs = []
    for out, (measure, p) in requests.items():
        if not 0 <= p <= 100:
            raise ValueError(f"percentile {p} outside 0..100")
        i = ids[measure]
        pos = f"(CAST({p} AS BIGINT) * (_n - 1))"
        lo_rank = f"({pos} div 100)"
        hi_rank = f"({lo_rank} + CASE WHEN {pos} % 100 > 0 THEN 1 ELSE 0 END)"

        def value_at(rank: str) -> str:
            return f"CAST(max(CASE WHEN _m = {i} AND _end - _c <= {rank} AND {rank} < _end THEN _v END) AS {_WIDE})"

        lo, hi = value_at(lo_rank), value_at(hi_rank)
        fr = f"CAST(max(CASE WHEN _m = {i} THEN {pos} % 100 END) AS {_WIDE})"
        aggs.append(F.expr(f"{lo} * 100 + ({hi} - {lo}) * {fr}").alias(out))
    return ranked.groupBy(*keys).agg(*aggs)


def percentile_numerators(
    df: DataFrame,
    keys: list[str],
    measures: Mapping[str, str | Column],
    requests: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """One row per key combination with a non-null value of any measure (a
    caller that needs the other combinations joins them from the left).

    ``measures`` maps a name to an integral SQL expression or Column (nulls
    are ignored, as in SQL). ``requests`` maps an output name to (measure
    name, p in percent). Each output column holds
    X = 100 * PERCENTILE_CONT(p/100) as decimal(38,0), null when the measure
    has no non-null value in the group; divide by 100 * unit and round with
    ``round_ratio``.
    """
    return percentiles_of_counts(value_counts(df, keys, measures), keys, list(measures), requests)
