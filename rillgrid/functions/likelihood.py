"""Debris-flow likelihood and rainfall thresholds of four logistic models.

A model has an intercept and coefficients of terrain (T), fire (F) and soil (S) for each of three
durations. Results are long tables: a row per segment, storm (or probability) and duration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DurationError
from .expr import INF, NAN, divide, ln, number

DURATIONS = (15, 30, 60)
#: Model: (B, Ct, Cf, Cs), each for 15, 30 and 60 minutes.
PARAMETERS: dict[str, tuple[tuple[float, ...], ...]] = {
    "M1": ((-3.63, -3.61, -3.21), (0.41, 0.26, 0.17), (0.67, 0.39, 0.20), (0.70, 0.50, 0.22)),
    "M2": ((-3.62, -3.61, -3.22), (0.64, 0.42, 0.27), (0.65, 0.38, 0.19), (0.68, 0.49, 0.22)),
    "M3": ((-3.71, -3.79, -3.46), (0.32, 0.21, 0.14), (0.33, 0.19, 0.10), (0.47, 0.36, 0.18)),
    "M4": ((-3.60, -3.64, -3.30), (0.51, 0.33, 0.20), (0.82, 0.46, 0.24), (0.27, 0.26, 0.13)),
}


def parameters(model: str, durations=DURATIONS) -> list[tuple[int, float, float, float, float]]:
    """(duration, B, Ct, Cf, Cs) for the durations asked for, in their order."""
    if model not in PARAMETERS:
        raise ValueError(f"no model {model}; there are {', '.join(PARAMETERS)}")
    wrong = [d for d in durations if d not in DURATIONS]
    if wrong:
        raise DurationError(f"no parameters for {wrong}; there are some for {DURATIONS}")
    return [(int(d), *(p[DURATIONS.index(d)] for p in PARAMETERS[model])) for d in durations]


def parameter_table(spark: SparkSession, models=tuple(PARAMETERS), durations=DURATIONS) -> DataFrame:
    """``(model, run_idx, duration, b, ct, cf, cs)``."""
    rows = [(m, i, *p) for m in models for i, p in enumerate(parameters(m, durations))]
    return spark.createDataFrame(rows, "model string, run_idx int, duration int, b double, ct double, cf double, cs double")


def _weight(ct, t, cf, f, cs, s) -> Column:
    return number(ct) * number(t) + number(cf) * number(f) + number(cs) * number(s)


def likelihood(r, b, ct, t, cf, f, cs, s) -> Column:
    """Probability at accumulation ``r``; NaN where the exponential overflows."""
    power = F.exp(number(b) + _weight(ct, t, cf, f, cs, s) * number(r))
    return F.when(F.isnan(power) | (power == INF), F.lit(NAN)).otherwise(power / (1 + power))


def accumulation(p, b, ct, t, cf, f, cs, s, screen: bool = True) -> Column:
    """Rainfall at which the probability is ``p``; negative results are NaN if ``screen``. p = 1 gives infinity."""
    odds = divide(p, 1 - number(p))
    r = divide(ln(odds) - number(b), _weight(ct, t, cf, f, cs, s))
    return F.when(r < 0, F.lit(NAN)).otherwise(r) if screen else r


def _axis(table: DataFrame, values, name: str, runs: DataFrame) -> DataFrame:
    """Segments with every value and run. Both axes are literals of a few rows, so their broadcast has a known size."""
    spark = table.sparkSession
    values = [values] if isinstance(values, (int, float)) else list(values)
    axis = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"{name}_idx int, {name} double")
    return table.crossJoin(F.broadcast(axis)).crossJoin(F.broadcast(runs))


def likelihoods(variables: DataFrame, r, model: str, durations=DURATIONS, column: str = "likelihood") -> DataFrame:
    """``variables(.., t, f, s)`` at every accumulation of ``r`` (mm), none of them negative, and duration."""
    if any(v < 0 for v in ([r] if isinstance(r, (int, float)) else r)):
        raise ValueError("accumulations aren't negative")
    return _axis(variables, r, "r", parameter_table(variables.sparkSession, (model,), durations)).withColumn(column, likelihood("r", "b", "ct", "t", "cf", "f", "cs", "s"))


def likelihoods_at_intensity(variables: DataFrame, i, model: str, durations=DURATIONS) -> DataFrame:
    """The same for intensities (mm/hour), a storm being one intensity over each duration."""
    table = _axis(variables, i, "i", parameter_table(variables.sparkSession, (model,), durations)).withColumn("r", F.col("i") * F.col("duration") / 60)
    return table.withColumn("likelihood", likelihood("r", "b", "ct", "t", "cf", "f", "cs", "s"))


def accumulations(variables: DataFrame, p, model: str, durations=DURATIONS, screen: bool = True) -> DataFrame:
    """``variables(.., t, f, s)`` with the threshold of every probability and duration, also as intensity (mm/hour)."""
    values = [p] if isinstance(p, (int, float)) else list(p)
    if any(not 0 <= v <= 1 for v in values):
        raise ValueError("probabilities lie between 0 and 1")
    table = _axis(variables, values, "p", parameter_table(variables.sparkSession, (model,), durations))
    return table.withColumn("accumulation", accumulation("p", "b", "ct", "t", "cf", "f", "cs", "s", screen)).withColumn("intensity", F.col("accumulation") * 60 / F.col("duration"))


def sweep(variables: DataFrame, r, runs: DataFrame) -> DataFrame:
    """Likelihoods for any ``runs(run_idx, b, ct, cf, cs)``; the runs are joined as their size decides."""
    values = [r] if isinstance(r, (int, float)) else list(r)
    axis = variables.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "r_idx int, r double")
    return variables.crossJoin(F.broadcast(axis)).crossJoin(runs).withColumn("likelihood", likelihood("r", "b", "ct", "t", "cf", "f", "cs", "s"))
