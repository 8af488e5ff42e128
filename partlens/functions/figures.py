"""Counts and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column, places: int = 2, empty: float | None = 0.0) -> Column:
    """``part`` as a percentage of ``whole``, rounded half up to ``places`` digits.

    The rounding is done on whole numbers, so every engine gives the same
    digits. ``empty`` is returned when ``whole`` is zero.
    """
    scale = 10**places
    part, whole = part.cast("bigint"), whole.cast("bigint")
    rounded = F.call_function("div", part * (200 * scale) + whole, whole * 2) / F.lit(float(scale))
    return F.when(whole > 0, rounded).otherwise(F.lit(empty).cast("double"))


def count_where(condition: Column) -> Column:
    """How many rows satisfy ``condition``."""
    return F.count_if(condition)


def sum_where(condition: Column, weight: Column) -> Column:
    """Sum of ``weight`` over the rows satisfying ``condition``; 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")


def total(weight: Column) -> Column:
    """Sum of ``weight``; 0 on empty input."""
    return F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")


def distinct_with_null(column: Column) -> Column:
    """Distinct values, counting NULL as one more value when there is a NULL."""
    has_null = F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))
    return F.count_distinct(column) + has_null
