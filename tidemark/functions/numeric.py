"""Guarded arithmetic and small numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocab


def to_number(raw: Column) -> Column:
    """Text to double: per cent signs and thousands commas are dropped (not
    divided by 100), anything unparseable or NaN becomes null."""
    n = F.regexp_replace(raw.cast("string"), "[%,]", "").try_cast("double")
    return F.when(F.isnan(n), None).otherwise(n)


def no_nan(v: Column) -> Column:
    """NaN is a value in Spark; missing must be null."""
    return F.when(~F.isnan(v), v)


def guarded_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Ratio, or ``default`` when the denominator is numerically zero."""
    return F.when(F.abs(denominator) < vocab.DIVISION_FLOOR, F.lit(default)).otherwise(
        F.try_divide(numerator, denominator))


def growth(current: Column, reference: Column, absolute: bool = True,
           difference: Column | None = None) -> Column:
    """Relative change, or the plain difference where ``difference`` holds."""
    base = F.abs(reference) if absolute else reference
    ratio = F.when(reference != 0, F.try_divide(current - reference, base))
    if difference is None:
        return ratio
    return F.when(difference, current - reference).otherwise(ratio)


def histogram_bins(n: Column) -> Column:
    """Number of equal-width bins for ``n`` observations."""
    return F.when(n < 1, 2).otherwise(
        F.greatest(F.lit(2), F.ceil(F.least(F.sqrt(n), 10 * F.log10(n))).cast("int")))


def recommended_ops(nature: Column) -> Column:
    """Default transform chain for the nature of a variable."""
    out = F.array(F.lit("none"), F.lit("none"))
    for name, ops in vocab.NATURE_OPS.items():
        out = F.when(nature == name, F.array(*map(F.lit, ops))).otherwise(out)
    return out


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate over pairs; null for a constant side.

    The built-in one divides by zero on constants, so it is put together from
    the slope, which gives the sign, and the explained share."""
    slope, share = F.regr_slope(y, x), F.regr_r2(y, x)
    return F.when(slope == 0, F.when(share == 0, 0.0)).otherwise(F.signum(slope) * F.sqrt(share))
