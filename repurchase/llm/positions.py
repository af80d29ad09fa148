"""Places of rows in their sequence, however long one sequence is.

Rows are dealt by range over (key, order), so a key with a third of all rows is
spread over many tasks. A task numbers its own rows in one pass; what a
sequence has in earlier tasks is added afterwards from one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import stash


def _number(batches: Iterator[pd.DataFrame], key: str, xors: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows come sorted; adds ``_part``, ``_pos`` and the running XOR of each
    of ``xors`` as ``_run_<name>``, all within the task."""
    part = TaskContext.get().partitionId()
    last, count, carry = None, 0, {x: np.int64(0) for x in xors}
    for b in batches:
        if not len(b):
            continue
        keys = b[key].to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        goes_on = last is not None and keys[0] == last
        out = b.assign(_part=part)
        pos = np.arange(len(keys)) - np.repeat(first, sizes)
        if goes_on:
            pos[: sizes[0]] += count
        out["_pos"] = pos
        for x in xors:
            value = b[x].to_numpy()
            run = np.bitwise_xor.accumulate(value)
            run = run ^ np.repeat(run[first] ^ value[first], sizes)
            if goes_on:
                run[: sizes[0]] ^= carry[x]
            out[f"_run_{x}"], carry[x] = run, run[-1]
        last, count = keys[-1], int(pos[-1]) + 1
        yield out


def number_rows(rows: DataFrame, key: str, order: Sequence[str], xors: Sequence[str] = (), drop: Sequence[str] = (), name: str = "positions") -> DataFrame:
    """``rows`` with ``_pos`` (from 0, within ``key``, by ``order``) and
    ``_run_<x>`` (XOR of x over the rows up to this one, itself included).

    ``key`` and ``xors`` are long columns without nulls. Columns in ``drop`` serve
    the order only. ``order`` must tell
    rows apart for a long run of equal ones to be split; equal rows may come in
    either order.
    """
    schema = StructType([f for f in rows.schema.fields if f.name not in drop])
    for c in ("_part", "_pos", *(f"_run_{x}" for x in xors)):
        schema = schema.add(c, IntegerType() if c == "_part" else LongType())
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    own = stash(dealt.drop(*drop).mapInPandas(lambda batches: _number(batches, key, xors), schema), name)
    per = own.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), *(F.bit_xor(x).alias(f"_x_{x}") for x in xors))
    earlier = Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_before": F.sum("_n").over(earlier)} | {f"_x_{x}": F.bit_xor(f"_x_{x}").over(earlier) for x in xors})
    # A task can go on with one sequence only: at most one row per task.
    per = F.broadcast(stash(per.where("_before is not null").drop("_n"), f"{name}-offsets"))
    out = own.join(per, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")), "left")
    zero = F.lit(0).cast("long")
    moved = {"_pos": F.col("_pos") + F.coalesce("_before", zero)}
    moved |= {f"_run_{x}": F.col(f"_run_{x}").bitwiseXOR(F.coalesce(f"_x_{x}", zero)) for x in xors}
    return out.withColumns(moved).drop("_part", "_key", "_p", "_before", *(f"_x_{x}" for x in xors))
