"""Missing values. A missing amount is NULL; NaN and infinities become NULL at the scan (H3, Z-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: str | Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def strict_sum(value: str, steps: int) -> Column:
    """Aggregate: the sum where exactly ``steps`` amounts are there, else NULL (D1, Z-2)."""
    return F.when(F.count(value) == steps, F.sum(value))


def strict_weighted_sum(weight: str, value: str, parts: int) -> Column:
    """Aggregate: the weighted sum where all parts have weight and value, else NULL, even if the missing one has weight 0."""
    product = F.col(weight) * F.col(value)
    return F.when(F.count(product) == parts, F.sum(product))


def ratio(part: Column, whole: Column) -> Column:
    """A quotient that is NULL where the divisor is 0 or anything is missing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def difference(a: Column, b: Column) -> Column:
    """``a - b``, NULL where either is."""
    return a - b
