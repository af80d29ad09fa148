"""Exact rounding and division rules shared by every operator.

PostgreSQL rounds NUMERIC halves away from zero and divides exactly; Spark
and DuckDB differ from it and from each other on doubles. Wherever a measure
can be written as a ratio of integers (counts, cents, microseconds) it is
computed here with integer arithmetic, so the result is the exact
half-away-from-zero rounding of the true quotient, in any engine.

Each helper takes SQL text (a column name or expression) or a Column. Text
arguments are composed into one SQL expression, which the driver sends to
the JVM in one call instead of one call per operator node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed unit: microseconds in one day (EXTRACT(EPOCH ...) / 86400).
US_PER_DAY = 86_400_000_000

_WIDE = "decimal(38,0)"

Arg = Column | str | int


def _col(c: Arg) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, int):
        return F.lit(c)
    return F.expr(c)


def _texts(*args: Arg) -> list[str] | None:
    """SQL text of every argument, or None when one is a Column."""
    out = []
    for a in args:
        if isinstance(a, Column):
            return None
        out.append(str(a) if isinstance(a, int) else f"({a})")
    return out


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``), truncating toward zero; returns long."""
    return F.call_function("div", a, b)


def round_ratio_int_sql(n: str, d: str, dp: int) -> str:
    s = 10**dp
    nn = f"CAST({n} AS {_WIDE})"
    dd = f"NULLIF(CAST({d} AS {_WIDE}), 0)"
    return f"(CAST(signum({nn}) * signum({dd}) AS BIGINT) * ((abs({nn}) * {2 * s} + abs({dd})) div (abs({dd}) * 2)))"


def round_ratio_int(num: Arg, den: Arg, dp: int = 2) -> Column:
    """round(num / den, dp) * 10**dp as a long, halves away from zero.

    ``num`` and ``den`` are integral (count, cents, microseconds). Null when
    ``den`` is 0 or null. Computed in decimal(38,0) so sums of microseconds
    over billions of rows do not overflow.
    """
    t = _texts(num, den)
    if t is not None:
        return F.expr(round_ratio_int_sql(t[0], t[1], dp))
    scale = 10**dp
    n = _col(num).cast(_WIDE)
    d = F.nullif(_col(den).cast(_WIDE), F.lit(0).cast(_WIDE))
    q = idiv(F.abs(n) * F.lit(2 * scale) + F.abs(d), F.abs(d) * F.lit(2))
    return (F.signum(n) * F.signum(d)).cast("long") * q


def round_ratio(num: Arg, den: Arg, dp: int = 2) -> Column:
    """round(num / den, dp), halves away from zero, as DOUBLE (see round_ratio_int)."""
    t = _texts(num, den)
    if t is not None:
        return F.expr(f"CAST({round_ratio_int_sql(t[0], t[1], dp)} AS DOUBLE) / {float(10**dp)}")
    return scaled(round_ratio_int(num, den, dp), dp)


def scaled(units: Arg, dp: int) -> Column:
    """A long count of 10**-dp units as DOUBLE (exact IEEE division)."""
    t = _texts(units)
    if t is not None:
        return F.expr(f"CAST({t[0]} AS DOUBLE) / {float(10**dp)}")
    return _col(units).cast("double") / F.lit(float(10**dp))


def pct(part: Arg, whole: Arg, dp: int = 2) -> Column:
    """Percent part/whole*100 rounded half-up to ``dp`` places; null if whole=0."""
    t = _texts(part, whole)
    if t is not None:
        return round_ratio(f"CAST({t[0]} AS {_WIDE}) * 100", t[1], dp)
    return round_ratio(_col(part).cast(_WIDE) * F.lit(100), whole, dp)


def round_double(x: Arg, dp: int) -> Column:
    """Half-away-from-zero rounding of a DOUBLE by an explicit formula.

    Used only where the value is not a ratio of integers (mean of per-order
    ratios); the same formula is written in the oracle SQL.
    """
    s = float(10**dp)
    t = _texts(x)
    if t is not None:
        return F.expr(f"signum({t[0]}) * CAST(floor(abs({t[0]}) * {s} + 0.5) AS DOUBLE) / {s}")
    c = _col(x)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)


def micros_between_sql(start: str, end: str) -> str:
    return f"timestampdiff(MICROSECOND, {start}, {end})"


def micros_between(start: Arg, end: Arg) -> Column:
    """end - start in whole microseconds (long); null if either is null."""
    t = _texts(start, end)
    if t is not None:
        return F.expr(micros_between_sql(t[0], t[1]))
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def cents(money: Arg) -> Column:
    """A 2-dp money amount as a whole number of cents (long)."""
    return (_col(money).cast("decimal(38,2)") * F.lit(100)).cast("long")


def money(x: Arg) -> Column:
    """Cast a raw amount to the fixed money type before any sum."""
    return _col(x).cast("decimal(12,2)")


def days_over(us: Arg, days: float) -> Column:
    """Duration in microseconds strictly greater than ``days`` days."""
    return _col(us) > F.lit(int(round(days * US_PER_DAY)))


def days_at_most(us: Arg, days: float) -> Column:
    return _col(us) <= F.lit(int(round(days * US_PER_DAY)))


def money_over(cents_col: Arg, amount: float) -> Column:
    """Amount in cents strictly greater than ``amount`` currency units."""
    return _col(cents_col) > F.lit(int(round(amount * 100)))
