"""Operators on single cells, and checks of their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingNoDataError
from ..functions import classes as C
from ..functions import nodata as N
from ..functions.expr import number
from ..raster import Raster


def fill(raster: Raster, value) -> Raster:
    """NoData replaced by a value; the result has no NoData."""
    if raster.meta.nodata is None:
        return raster
    return raster.with_value(N.fill("value", raster.meta.nodata, value), nodata=None)


def find(raster: Raster, values) -> Raster:
    """Where a value is among those given, NaN included."""
    return raster.with_value(N.isin("value", list(values) if isinstance(values, (list, tuple, set)) else [values]), dtype="bool", nodata=False)


def range_value(value, nodata, low=None, high=None, fill: bool = False, exclude_bounds: bool = False) -> Column:
    """A value clamped to [low, high], or NoData outside; NoData stays. ``exclude_bounds`` makes the bounds outside, too."""
    if exclude_bounds and not fill:
        raise ValueError("bounds can only be excluded where values outside are filled")
    value = N.col(value)
    x = number(value)
    fixed = N.mask(value, nodata) | F.isnan(x)
    below = F.lit(False) if low is None else (x <= low if exclude_bounds else x < low)
    above = F.lit(False) if high is None else (x >= high if exclude_bounds else x > high)
    if fill:
        return F.when(fixed, value).when(below | above, F.lit(nodata)).otherwise(value)
    out = F.when(fixed, value)
    if low is not None:
        out = out.when(below, F.lit(low))
    if high is not None:
        out = out.when(above, F.lit(high))
    return out.otherwise(value)


def set_range(raster: Raster, low=None, high=None, fill: bool = False, exclude_bounds: bool = False) -> Raster:
    """Values clamped to a range, or NoData outside it."""
    if fill and raster.meta.nodata is None:
        raise MissingNoDataError("filling needs a NoData value")
    kind = dict(raster.cells.dtypes)["value"]
    return raster.with_value(range_value("value", raster.meta.nodata, low, high, fill, exclude_bounds).cast(kind))


def severity_estimate(dnbr: Raster, thresholds=(125, 250, 500)) -> Raster:
    """Burn severity of a differenced burn ratio."""
    return dnbr.with_value(C.severity_estimate("value", thresholds, dnbr.meta.nodata).cast("tinyint"), dtype="int8", nodata=0)


def severity_mask(severity: Raster, descriptions) -> Raster:
    """Where severity is among the classes described."""
    return severity.with_value(C.severity_mask("value", descriptions), dtype="bool", nodata=False)


def combine(a: Raster, b: Raster, how: str) -> Raster:
    """Masks joined by 'and' or 'or'."""
    b = a.validate(b)
    rows = a.cells.join(b.cells.withColumnRenamed("value", "__other"), ["row", "col"])
    left, right = F.col("value").cast("boolean"), F.col("__other").cast("boolean")
    return Raster(rows.select("row", "col", (left & right if how == "and" else left | right).alias("value")), a.meta.update(dtype="bool", nodata=False))


CHECKS = ("defined", "finite", "boolean", "integers", "positive", "nonnegative", "flow")


def fails(check: str, value, nodata=None, low: float | None = None, high: float | None = None) -> Column:
    """True where a value that isn't NoData breaks a rule: one of ``CHECKS``, or 'inrange' with bounds."""
    x = number(value)
    bad = {
        "defined": F.isnan(x),
        "finite": F.isnan(x) | (F.abs(x) == float("inf")),
        "boolean": F.isnan(x) | ~x.isin(0.0, 1.0),
        "integers": F.isnan(x) | (x != F.rint(x)),
        "positive": F.isnan(x) | (x <= 0),
        "nonnegative": F.isnan(x) | (x < 0),
        "flow": F.isnan(x) | (x != F.rint(x)) | (x < 1) | (x > 8),
        "inrange": F.isnan(x) | (F.lit(False) if low is None else x < low) | (F.lit(False) if high is None else x > high),
    }[check]
    return bad & ~N.mask(N.col(value), nodata)


def failures(raster: Raster, check: str, **bounds) -> DataFrame:
    """The cells that break a rule."""
    return raster.cells.where(fails(check, "value", raster.meta.nodata, **bounds))


def require(raster: Raster, check: str, **bounds) -> Raster:
    """The raster, or an error that names the first cell that breaks a rule."""
    first = failures(raster, check, **bounds).orderBy("row", "col").first()
    if first is not None:
        raise ValueError(f"{raster.meta.name} isn't {check} at row {first['row']}, column {first['col']}: {first['value']}")
    return raster
