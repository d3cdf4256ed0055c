"""Column expressions of outcomes and rates. A zero denominator gives 0, except the net rate, which is then -50."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
FULL_CONFIDENCE = 5000.0
LOW_SAMPLE = 20


def rnd(x: Column, digits: int = 6, half_even: bool = False) -> Column:
    """Rounding of stored rates: half up by default, half to even where results must agree with Python's."""
    return F.bround(x, digits) if half_even else F.round(x, digits)


def outcome(own: Column, other: Column) -> list[Column]:
    """wins, losses, draws as 0 or 1."""
    return [
        F.when(own > other, 1).otherwise(0).alias("w"),
        F.when(own < other, 1).otherwise(0).alias("l"),
        F.when(own == other, 1).otherwise(0).alias("d"),
    ]


def result(own: Column, other: Column) -> Column:
    return F.when(own > other, "win").when(own < other, "loss").otherwise("draw")


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, unrounded."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def clean_rate(w: Column, l: Column) -> Column:
    return share(w, w + l)


def net_rate(w: Column, l: Column) -> Column:
    return clean_rate(w, l) - 50.0


def _wilson(w: Column, l: Column, sign: int) -> Column:
    n = (w + l).cast("double")
    p = F.try_divide(w.cast("double"), n)
    z2 = Z * Z
    middle, reach = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return F.when(n > 0, (middle + sign * reach) / (1 + z2 / n))


def wilson_lower(w: Column, l: Column) -> Column:
    """Lower bound of the Wilson interval as a share of 1, not below 0, rounded to 6 digits."""
    return F.coalesce(rnd(F.greatest(F.lit(0.0), _wilson(w, l, -1))), F.lit(0.0))


def wilson_interval(w: Column, l: Column) -> tuple[Column, Column]:
    """Both bounds in percent, unrounded, inside [0, 100]; (0, 0) without decisions."""
    decided = w + l > 0
    low = F.when(decided, F.greatest(F.lit(0.0), _wilson(w, l, -1)) * 100).otherwise(0.0)
    high = F.when(decided, F.least(F.lit(1.0), _wilson(w, l, 1)) * 100).otherwise(0.0)
    return low, high


def confidence(w: Column, l: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt((w + l) / F.lit(FULL_CONFIDENCE)))


def rating(wilson: Column, percentile: Column, sure: Column) -> Column:
    return 100 * (0.65 * wilson + 0.20 * percentile + 0.15 * sure)


def low_sample(games: Column, threshold: int = LOW_SAMPLE) -> Column:
    """The low-sample warning code, null at ``threshold`` games or more."""
    return F.when(games < threshold, F.lit("LOW_SAMPLE_WARNING"))
