"""Combined hazard of likelihood and volume."""

from __future__ import annotations

from pyspark.sql import Column

from .classes import check_thresholds, classify
from .expr import checked as _checked
from .expr import number

P_THRESHOLDS = (0.25, 0.5, 0.75)
V_THRESHOLDS = (1e3, 1e4, 1e5)
H_THRESHOLDS = (3, 6)


def pscore(likelihood, thresholds=P_THRESHOLDS) -> Column:
    """Class 1 to 4 of a probability, NaN at NaN; a value beyond 0 to 1 is an error."""
    checked = check_thresholds(thresholds, 3)
    if any(not 0 <= t <= 1 for t in checked):
        raise ValueError("probability thresholds lie between 0 and 1")
    return classify(_checked(likelihood, "a likelihood", high=1), checked)


def vscore(volume, thresholds=V_THRESHOLDS) -> Column:
    """Class 1 to 4 of a volume, NaN at NaN; a negative one is an error."""
    checked = check_thresholds(thresholds, 3)
    if any(t <= 0 for t in checked):
        raise ValueError("volume thresholds are positive")
    return classify(_checked(volume, "a volume"), checked)


def hscore(combined, thresholds=H_THRESHOLDS) -> Column:
    """Class 1 to 3 of a sum of scores, NaN at NaN."""
    checked = check_thresholds(thresholds, 2)
    if any(t != int(t) or t <= 0 for t in checked):
        raise ValueError("hazard thresholds are positive whole numbers")
    return classify(combined, checked)


def hazard(likelihood, volume, p_thresholds=P_THRESHOLDS, v_thresholds=V_THRESHOLDS, h_thresholds=H_THRESHOLDS) -> Column:
    """1 (low), 2 (moderate) or 3 (high); NaN where either input is."""
    return hscore(number(pscore(likelihood, p_thresholds)) + number(vscore(volume, v_thresholds)), h_thresholds)
