"""Rainfall intensity (per hour) and accumulation over a duration in minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DurationError
from .expr import number


def check_durations(durations: list[float]) -> list[float]:
    """Positive durations."""
    if not durations or any(not d > 0 for d in durations):
        raise DurationError("durations must be positive")
    return [float(d) for d in durations]


def to_accumulation(intensity, duration) -> Column:
    return number(intensity) * number(duration) / 60


def from_accumulation(accumulation, duration) -> Column:
    return number(accumulation) * 60 / number(duration)


def with_durations(table: DataFrame, durations: list[float], column: str = "duration") -> DataFrame:
    """Every row with every duration: an axis of a few rows, so the join is a broadcast of known size."""
    axis = table.sparkSession.createDataFrame([(i, d) for i, d in enumerate(check_durations(durations))], f"{column}_idx int, {column} double")
    return table.crossJoin(F.broadcast(axis))
