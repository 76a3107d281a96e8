"""NoData: sentinels and NaN in a cell's value, never null."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CastingError
from .expr import NAN, col, number

#: Spark type of each raster dtype; unsigned ones take the next larger signed type.
SPARK_TYPES = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def default(dtype: str):
    """The NoData value of a dtype that none is given for: NaN, least signed, greatest unsigned, or False."""
    kind = np.dtype(dtype)
    if kind.kind == "b":
        return False
    if kind.kind == "f":
        return NAN
    if kind.kind not in "iu":
        raise CastingError(f"{dtype} is not a real number type")
    limits = np.iinfo(kind)
    return int(limits.min if kind.kind == "i" else limits.max)


def cast(value, dtype: str, casting: str = "safe"):
    """A NoData value as a dtype, if it survives the cast or the rule allows it."""
    source = np.asarray(value)
    if source.dtype.kind not in "biuf" or source.ndim:
        raise CastingError("NoData must be one real number")
    with np.errstate(all="ignore"):
        out = source.astype(dtype)
    same = bool(out == source) or bool(out != out and source != source)
    kind = np.float64 if source.dtype.kind == "f" else source.dtype
    if not same and not np.can_cast(kind, np.dtype(dtype), casting):
        raise CastingError(f"{value} as {dtype} is not a {casting} cast")
    return out.item()


def is_nan(nodata) -> bool:
    """Whether a NoData value is NaN."""
    return isinstance(nodata, float) and math.isnan(nodata)


def equal(a, b) -> bool:
    """Whether two NoData values are the same, NaN being itself."""
    if a is None or b is None:
        return a is b
    return a == b or is_nan(a) and is_nan(b)


def mask(value, *nodata) -> Column:
    """True where a value is one of the NoData values; with none given (or only None), false."""
    value, out = col(value), F.lit(False)
    for sentinel in nodata:
        if sentinel is not None:
            hit = F.isnan(value.cast("double")) if is_nan(sentinel) else value == F.lit(sentinel)
            out = out | F.coalesce(hit, F.lit(False))
    return out


def data_mask(value, *nodata) -> Column:
    return ~mask(value, *nodata)


def fill(value, nodata, replacement) -> Column:
    """The value with NoData replaced; as a double if the replacement is NaN."""
    value = col(value)
    if isinstance(replacement, float) and math.isnan(replacement):
        value = value.cast("double")
    return F.when(mask(value, nodata), F.lit(replacement)).otherwise(value)


def to_nan(value, nodata) -> Column:
    """As a double with NoData as NaN, the form that every aggregate takes."""
    return F.when(mask(col(value), nodata), F.lit(NAN)).otherwise(number(value))


def any_nodata(value, nodata) -> Column:
    """An aggregate: whether any value is NoData."""
    return F.coalesce(F.bool_or(mask(value, nodata)), F.lit(False))


def isin(value, values: list) -> Column:
    """Membership in a list, in which NaN may stand."""
    value = col(value)
    plain = [v for v in values if not is_nan(v)]
    found = value.isin(plain) if plain else F.lit(False)
    nan = any(is_nan(v) for v in values)
    return F.coalesce(found | (F.isnan(value.cast("double")) if nan else F.lit(False)), F.lit(False))
