"""Null-safe arithmetic used by rates, ratios and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NumberLike = Column | float | int


def _col(value: NumberLike) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finite_double(value: Column) -> Column:
    """Double, or null when the text does not parse or is NaN or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def number_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def safe_div(numerator: Column, denominator: NumberLike) -> Column:
    """Quotient, null unless the denominator is above zero."""
    d = _col(denominator)
    return F.when(d > 0, numerator / d)


def safe_div_min(numerator: Column, denominator: Column, smallest: float) -> Column:
    """Quotient, null while the denominator is below ``smallest``."""
    return F.when(denominator >= smallest, numerator / denominator)


def safe_div_smooth(
    numerator: Column, denominator: Column, smallest: float, add_top: float = 1.0,
    add_bottom: float = 2.0,
) -> Column:
    """Additively smoothed quotient with the same support rule as :func:`safe_div_min`."""
    return F.when(denominator >= smallest, (numerator + add_top) / (denominator + add_bottom))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp into [low, high]; null stays null (plain least/greatest would drop the null)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round the binary value to the nearest decimal, exact halves to even, as published numbers were.

    ``bround`` rounds the shortest decimal text instead, which puts 0.00625 and 2.675 on the wrong side.
    A double times a power of two is a whole number; from there on everything is whole-number arithmetic.
    """

    def rounded(x: Column) -> Column:
        size = F.abs(x)
        power = F.least(F.greatest(53 - F.floor(F.log2(size)), F.lit(0)), F.lit(93)).cast("int")
        first = F.least(power, F.lit(62))
        whole = (size * F.pow(F.lit(2.0), power)).cast("bigint").cast("decimal(20,0)")
        scaled = (whole * F.lit(10**digits).cast("decimal(12,0)")).cast("decimal(38,0)")

        def power_of_two(by: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("bigint"), by).cast("decimal(19,0)")

        unit = (power_of_two(first) * power_of_two(power - first)).cast("decimal(38,0)")
        rest = (scaled % unit).cast("decimal(38,0)")
        down = ((scaled - rest) / unit).cast("bigint")
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
        return F.signum(x) * (down + up.cast("bigint")).cast("double") / float(10**digits) + 0.0

    def guarded(x: Column) -> Column:
        plain = x.isNull() | F.isnan(x) | (x == 0) | (F.abs(x) >= 2.0**53 / 10**digits)
        return F.when(plain, x + 0.0).otherwise(rounded(x))

    return F.element_at(F.transform(F.array(value.cast("double")), guarded), 1)


def as_flag(condition: Column) -> Column:
    """Two-valued boolean: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def risk_tier(probability: Column) -> Column:
    return (
        F.when(probability < 0.05, "Low").when(probability < 0.20, "Medium")
        .when(probability.isNotNull(), "High")
    )


def stable_bucket_hex(key: Column, seed: int) -> Column:
    """First 16 hex digits of sha256("<seed>:<key>")."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)


def stable_bucket(key: Column, seed: int) -> Column:
    """Stable pseudo-uniform number in [0, 1) for a key."""
    top = F.conv(F.substring(stable_bucket_hex(key, seed), 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(stable_bucket_hex(key, seed), 9, 8), 16, 10).cast("double")
    return (top * F.lit(float(2**32)) + low) / F.lit(float(2**64))
