"""Column-level helpers: exact rounding, shares, tiers, exact percentiles."""

from .numeric import (
    US_PER_DAY,
    cents,
    days_at_most,
    days_over,
    idiv,
    micros_between,
    money,
    money_over,
    pct,
    round_double,
    round_ratio,
    round_ratio_int,
    scaled,
)
from .quantiles import percentile_numerators, percentiles_of_counts, value_counts
from .shares import tier, with_share

__all__ = [
    "US_PER_DAY",
    "cents",
    "days_at_most",
    "days_over",
    "idiv",
    "micros_between",
    "money",
    "money_over",
    "pct",
    "percentile_numerators",
    "percentiles_of_counts",
    "round_double",
    "round_ratio",
    "round_ratio_int",
    "scaled",
    "tier",
    "value_counts",
    "with_share",
]
