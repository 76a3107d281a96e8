"""Classes of values, and burn severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import NAN, number
from .nodata import mask as nodata_mask

#: Burn severity classes; ``burned`` is low to high.
SEVERITY = {"unburned": [1], "low": [2], "moderate": [3], "high": [4], "burned": [2, 3, 4]}


def check_thresholds(thresholds, count: int | None = None) -> list[float]:
    """Thresholds in ascending order, of the number asked for."""
    out = [float(t) for t in thresholds]
    if any(t != t for t in out) or out != sorted(out):
        raise ValueError("thresholds must ascend")
    if count is not None and len(out) != count:
        raise ValueError(f"there must be {count} thresholds")
    return out


def classify(value, thresholds, nodata=NAN, nodata_to=NAN) -> Column:
    """1 for values up to the first threshold, 2 up to the second, and so on; NoData becomes ``nodata_to``.

    Bounds belong to the class below. Minus infinity is in class 0. A NaN that isn't NoData is above every class.
    """
    x, bounds = number(value), check_thresholds(thresholds)
    as_double = nodata_to != nodata_to or isinstance(nodata_to, float)
    kind = "double" if as_double else "int"
    lit = lambda k: F.lit(k).cast(kind)
    out = F.when(nodata_mask(x, None if nodata is None else float(nodata)), lit(nodata_to)).when(F.isnan(x), lit(len(bounds) + 2))
    out = out.when(x == float("-inf"), lit(0))
    for k, bound in enumerate(bounds):
        out = out.when(x <= bound, lit(k + 1))
    return out.otherwise(lit(len(bounds) + 1))


def severity_estimate(dnbr, thresholds=(125, 250, 500), nodata=None) -> Column:
    """Severity 1 to 4 of a differenced burn ratio; 0 where it is NoData."""
    return classify(dnbr, check_thresholds(thresholds, 3), nodata, 0)


def severity_mask(severity, descriptions) -> Column:
    """Where a severity is among the classes described; ``classes()`` has the names."""
    wanted = [descriptions] if isinstance(descriptions, str) else list(descriptions)
    unknown = [d for d in wanted if d.lower() not in SEVERITY]
    if unknown or not wanted:
        raise ValueError(f"no severity {unknown}; there are {', '.join(SEVERITY)}")
    return number(severity).isin(sorted({float(k) for d in wanted for k in SEVERITY[d.lower()]}))


def classes() -> dict[str, int | list[int]]:
    """Severity classes by description."""
    return {name: ids[0] if len(ids) == 1 else list(ids) for name, ids in SEVERITY.items()}
