"""Units of length and area."""

from __future__ import annotations

from pyspark.sql import Column

from .expr import col

FOOT = 0.3048
_METERS = {"meters": 1.0, "kilometers": 1000.0, "feet": FOOT, "miles": 5280 * FOOT}
_SPELLINGS = {"metres": "meters", "kilometres": "kilometers"}


def standardize(unit: str) -> str:
    """The one spelling of a unit, in lower case."""
    unit = unit.strip().lower()
    unit = _SPELLINGS.get(unit, unit)
    if unit not in (*_METERS, "base"):
        raise ValueError(f"no unit {unit!r}; there are {', '.join(supported())}")
    return unit


def supported() -> list[str]:
    """Names of all units, ``base`` being that of the axes."""
    return ["base", "meters", "metres", "kilometers", "kilometres", "feet", "miles"]


def units_per_meter() -> dict[str, float]:
    """How many of each unit are a metre; NaN for ``base``."""
    own = {name: 1 / size for name, size in _METERS.items()}
    return {"base": float("nan")} | own | {k: own[v] for k, v in _SPELLINGS.items()}


def factor(from_units: str, to_units: str) -> float:
    """What a length in one unit is multiplied by for another."""
    source, target = standardize(from_units), standardize(to_units)
    if "base" in (source, target) and source != target:
        raise ValueError("base units depend on the axes; convert with a raster's metadata")
    return 1.0 if source == target else _METERS[source] / _METERS[target]


def convert(distance, from_units: str, to_units: str) -> Column:
    """A distance in other units."""
    return col(distance) * factor(from_units, to_units)
