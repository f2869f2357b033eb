"""Numeric expressions whose text and rounding must be the same in every engine."""

from pyspark.sql import Column, functions as F


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text with `digits` places; halves of the exact binary value go to the even digit."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def half_even(x: Column, digits: int) -> Column:
    """Correctly rounded double (`F.round` is half-up, `F.bround` rounds the decimal text); infinities stay."""
    # Adding 0.0 turns -0.0 into 0.0 and changes nothing else.
    rounded = fixed_text(x, digits).try_cast("double") + F.lit(0.0)
    return F.when(F.abs(x.cast("double")) == float("inf"), x.cast("double")).otherwise(rounded)


def nan_to_null(x: Column) -> Column:
    """NaN sorts above every number in Spark and spoils averages, so it becomes NULL on ingest."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def signed_text(x: Column, digits: int = 0) -> Column:
    text = fixed_text(x, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def compact_text(x: Column) -> Column:
    """Whole number when within 0.05 of one, else one decimal."""
    whole = F.rint(x)
    return F.when(F.abs(x - whole) < 0.05, fixed_text(whole + F.lit(0.0), 0)).otherwise(fixed_text(x, 1))


def percent_of(part: Column, base: Column) -> Column:
    """`part / base * 100`, 0 where the base is not positive."""
    return F.when(base > 0, part / base * 100).otherwise(F.when(base.isNotNull(), F.lit(0.0)))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over the rows that have both values, NULL where one of them does not vary.

    `F.corr` raises on a constant column in ANSI mode; the two regression slopes are NULL there and their
    product is the squared correlation.
    """
    slope, inverse = F.regr_slope(a, b), F.regr_slope(b, a)
    return F.signum(slope) * F.sqrt(slope * inverse)


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """`value op threshold` for `<`, `>`, `<=`, `>=`; any other operator, or a NULL value, is false."""
    test = (
        F.when(op == "<", value < threshold)
        .when(op == ">", value > threshold)
        .when(op == "<=", value <= threshold)
        .when(op == ">=", value >= threshold)
    )
    return F.coalesce(test, F.lit(False))
