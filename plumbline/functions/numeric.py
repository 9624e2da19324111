"""Small arithmetic used by comparisons, rules and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_change(base: Column, current: Column) -> Column:
    """(current - base) / |base| * 100; null when the base is zero or either is null."""
    return F.when(base != 0, (current - base) / F.abs(base) * 100)


def lower_bound(value: Column, tolerance: Column | float) -> Column:
    return value - F.abs(value) * tolerance


def upper_bound(value: Column, tolerance: Column | float) -> Column:
    return value + F.abs(value) * tolerance


def share(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole as a double; ``empty`` when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty).cast("double"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fixed(value: Column, digits: int) -> Column:
    """Text with exactly ``digits`` decimals, rounded half up."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def grouped(value: Column, digits: int = 2) -> Column:
    """Text with thousands separators and at most ``digits`` decimals."""
    pattern = "#,##0" + ("." + "#" * digits if digits else "")
    return F.call_function("format_number", F.round(value.cast("double"), digits), F.lit(pattern))


def plain(value: Column) -> Column:
    """Shortest text of a number: whole numbers carry no decimal point."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
