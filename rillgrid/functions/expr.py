"""Arithmetic with IEEE results, where Spark would give null or raise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def col(value) -> Column:
    """A column by name, a column as it is, or a literal."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def number(value) -> Column:
    """As a double, with null as NaN."""
    return F.coalesce(col(value).cast("double"), F.lit(NAN))


def ln(value) -> Column:
    """Natural logarithm: -inf at 0, NaN below and at NaN."""
    x = number(value)
    return F.when(x == 0, F.lit(-INF)).when(F.isnan(x) | (x < 0), F.lit(NAN)).otherwise(F.ln(x))


def divide(a, b) -> Column:
    """Quotient: x/0 is infinite, 0/0 NaN."""
    x, y = number(a), number(b)
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, at_zero).otherwise(x / F.when(y != 0, y))


def at_least(a, b) -> Column:
    """a >= b, false where either is NaN (Spark takes NaN for the greatest number)."""
    x, y = number(a), number(b)
    return ~F.isnan(x) & ~F.isnan(y) & (x >= y)


def sql_number(x: float) -> str:
    """A literal that Spark and DuckDB read as the same double."""
    if math.isnan(x) or math.isinf(x):
        return f"CAST('{x}' AS DOUBLE)"
    return f"CAST({x!r} AS DOUBLE)"


def checked(value, name: str, low: float = 0.0, high: float = INF) -> Column:
    """A number that must lie between two bounds; the query fails where one doesn't. NaN and null pass."""
    x = number(value)
    wrong = ~F.isnan(x) & ((x < low) | (x > high))
    text = F.concat(F.lit(f"{name} must lie between {low:g} and {high:g}, and one is "), x.cast("string"))
    return F.when(wrong, F.raise_error(text).cast("double")).otherwise(x)
