"""Slope gradients (rise over run) to and from other measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import NAN, number


def to_percent(slope) -> Column:
    return number(slope) * 100


def to_radians(slope) -> Column:
    return F.atan(number(slope))


def to_degrees(slope) -> Column:
    return F.degrees(F.atan(number(slope)))


def to_sine(slope) -> Column:
    return F.sin(F.atan(number(slope)))


def from_percent(percent) -> Column:
    return number(percent) / 100


def from_radians(theta) -> Column:
    return F.tan(number(theta))


def from_degrees(theta) -> Column:
    return F.tan(F.radians(number(theta)))


def from_sine(sine) -> Column:
    """NaN outside [-1, 1]."""
    x = number(sine)
    return F.when(F.isnan(x) | (F.abs(x) > 1), F.lit(NAN)).otherwise(F.tan(F.asin(x)))
