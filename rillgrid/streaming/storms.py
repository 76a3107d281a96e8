"""Storms scored as they arrive, against a static table of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hazard, likelihood, volume


def score(storms: DataFrame, segments: DataFrame, model: str = "M1", duration: int = 15) -> DataFrame:
    """Likelihood, volume and hazard of every segment in every storm ``(storm_id, ts, region, i15)``.

    ``segments(id, region, t, f, s, bmh, relief)`` is static, so the join has no state and late storms are scored like
    others. Works on batches, too. A null or negative intensity is dropped.
    """
    _, b, ct, cf, cs = likelihood.parameters(model, (duration,))[0]
    joined = storms.where("i15 >= 0").join(segments, "region")
    r = F.col("i15") * duration / 60
    scored = joined.withColumn("likelihood", likelihood.likelihood(r, b, ct, "t", cf, "f", cs, "s")).withColumn("volume", F.exp(volume.emergency_ln("i15", "bmh", "relief")))
    return scored.withColumn("hazard", hazard.hazard("likelihood", "volume").cast("int"))


def alerts(scored: DataFrame, delay: str = "10 minutes", window: str = "15 minutes") -> DataFrame:
    """Highest hazard and number of segments at hazard 3, by region and window of time; storms later than ``delay`` are left out."""
    timed = scored.withWatermark("ts", delay).groupBy(F.window("ts", window), "region")
    return timed.agg(F.max("hazard").alias("hazard"), F.sum((F.col("hazard") == 3).cast("bigint")).alias("n_high")).select(F.col("window.start").alias("start"), "region", "hazard", "n_high")
