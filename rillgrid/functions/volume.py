"""Potential sediment volume (cubic metres) with a confidence interval."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import checked, ln, number

EMERGENCY = {"b": 4.22, "ci": 0.39, "cb": 0.36, "cr": 0.13, "rse": 1.04}
LONGTERM = {"b": 6.07, "ci": 0.71, "cb": 0.22, "ct": -0.24, "ca": 0.49, "cr": 0.03, "rse": 1.25}


def emergency_ln(i15, bmh, relief, **c) -> Column:
    """Log volume from 15-minute intensity (mm/hour), area burned at moderate or high severity (km2) and relief (m)."""
    c = EMERGENCY | c
    return c["b"] + c["ci"] * F.sqrt(number(i15)) + c["cb"] * ln(bmh) + c["cr"] * F.sqrt(number(relief))


def longterm_ln(i60, bt, years, area, relief, **c) -> Column:
    """Log volume from 60-minute intensity, burned area (km2), years since the fire, catchment area (km2) and relief (m)."""
    c = LONGTERM | c
    return c["b"] + c["ci"] * ln(i60) + c["cb"] * ln(bt) + c["ct"] * ln(years) + c["ca"] * ln(area) + c["cr"] * F.sqrt(number(relief))


def multiplier(ci: float, rse: float) -> float:
    """Half the width of the interval of confidence ``ci``, in log volume."""
    if not 0 <= ci <= 1 or rse < 0:
        raise ValueError("a confidence lies between 0 and 1, an error isn't negative")
    return float("inf") if ci == 1 else NormalDist().inv_cdf(1 - (1 - ci) / 2) * rse


def volume(log_volume: Column) -> Column:
    return F.exp(log_volume)


def bounds(log_volume: Column, ci: float, rse: float) -> tuple[Column, Column]:
    """Lower and upper volume."""
    half = multiplier(ci, rse)
    return F.exp(log_volume - F.lit(half)), F.exp(log_volume + F.lit(half))


def _storms(table: DataFrame, intensities, name: str) -> DataFrame:
    values = [intensities] if isinstance(intensities, (int, float)) else list(intensities)
    if any(not v >= 0 for v in values):
        raise ValueError("intensities aren't negative")
    axis = table.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"storm_idx int, {name} double")
    return table.crossJoin(F.broadcast(axis))


def _with_bounds(table: DataFrame, log_volume: Column, cis, rse: float) -> DataFrame:
    table = table.withColumn("ln_volume", log_volume).withColumn("volume", F.exp("ln_volume"))
    if cis is None:
        return table
    values = [cis] if isinstance(cis, (int, float)) else list(cis)
    axis = table.sparkSession.createDataFrame([(i, float(c), multiplier(c, rse)) for i, c in enumerate(values)], "ci_idx int, ci double, half double")
    out = table.crossJoin(F.broadcast(axis))
    return out.withColumn("volume_min", F.exp(F.col("ln_volume") - F.col("half"))).withColumn("volume_max", F.exp(F.col("ln_volume") + F.col("half"))).drop("half")


def emergency(table: DataFrame, i15, ci=0.95, **c) -> DataFrame:
    """``table(.., bmh, relief)`` at every storm and confidence: volume, volume_min and volume_max; ``ci=None`` for no bounds. Negative variables are an error."""
    return _with_bounds(_storms(table, i15, "i15"), emergency_ln("i15", *(checked(v, v) for v in ("bmh", "relief")), **c), ci, c.get("rse", EMERGENCY["rse"]))


def longterm(table: DataFrame, i60, ci=0.95, **c) -> DataFrame:
    """``table(.., bt, years, area, relief)`` at every storm and confidence. Negative variables are an error."""
    return _with_bounds(_storms(table, i60, "i60"), longterm_ln("i60", *(checked(v, v) for v in ("bt", "years", "area", "relief")), **c), ci, c.get("rse", LONGTERM["rse"]))
