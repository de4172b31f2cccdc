"""Rounding, ratios, growth rates and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int) -> Column:
    """Rounded once, as a double; of a decimal sum that is exact."""
    return F.round(_col(c), digits).cast("double")


def exact_cents(c: Column | str) -> Column:
    """A value already rounded to cents as a decimal, for adding up without binary noise."""
    return _col(c).cast("decimal(18,2)")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; NULL when the denominator is 0, so that one empty cell cannot fail a job."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def growth_pct(value: Column | str, previous: Column | str) -> Column:
    return F.lit(100.0) * (ratio(value, previous) - F.lit(1.0))


def annual_growth(value: Column | str, base: Column | str, years: Column) -> Column:
    """Compound growth per year, as a fraction."""
    return F.pow(ratio(value, base), ratio(F.lit(1.0), years)) - F.lit(1.0)


def number_text(c: Column | str, digits: int) -> Column:
    """A number rounded to ``digits`` (0 to 2) as plain text with at least one decimal: ``1205848778.0``, ``0.01``.

    Goes through a decimal because Spark prints large doubles with an exponent.
    """
    if not 0 <= digits <= 2:
        raise ValueError("digits must be 0, 1 or 2")
    rounded = F.round(_col(c), digits)
    if digits < 2:
        return rounded.cast("decimal(38,1)").cast("string")
    return F.regexp_replace(rounded.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
