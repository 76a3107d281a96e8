"""The whole assessment: terrain to flow, streams, variables, likelihood, volume and hazard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hazard, likelihood, volume
from ..operators import cells, condition, flow, network, summary
from ..raster import Raster
from . import grids, tables


def assess(dem: Raster, dnbr: Raster, soil: Raster, *, stream_cells: float, i15: float, model: str = "M1", max_length: float = float("inf"), thresholds=(125, 250, 500)) -> DataFrame:
    """``(id, t, f, s, likelihood, volume, hazard, threshold)`` of every stream segment of a burned terrain.

    Flow, slopes and relief are those of the conditioned terrain, without pits, depressions and flats.
    ``i15`` is a storm's 15-minute intensity; ``threshold`` the intensity at which a debris flow is as likely as not.
    """
    spark = dem.cells.sparkSession
    work = tables.folder(spark)
    save = lambda r, n: Raster(tables.write(r.cells, f"{work}/{n}"), r.meta)
    dem = save(condition.condition(dem), "conditioned")
    directions = save(flow.directions(dem), "flow")
    upslope = save(flow.accumulation(directions), "upslope")
    streams = upslope.with_value(~F.isnan("value") & (F.col("value") >= stream_cells), dtype="bool", nodata=False)
    streams_network = network.build(directions, streams, max_length)
    slopes = save(flow.slopes(dem, directions), "slopes")
    heights = save(flow.relief(dem, directions), "relief")
    burned = save(cells.severity_mask(cells.severity_estimate(dnbr, thresholds), ["moderate", "high"]), "burned")
    variables = summary.m1_variables(streams_network, burned, slopes, dnbr, soil, omitnan=True)
    chance = likelihood.likelihoods_at_intensity(variables, i15, model, (15,)).select("id", "t", "f", "s", "likelihood")
    limit = likelihood.accumulations(variables, 0.5, model, (15,)).select("id", F.col("intensity").alias("threshold"))
    inputs = summary.burned_area(streams_network, burned).withColumnRenamed("value", "bmh").join(summary.relief(streams_network, heights).withColumnRenamed("value", "relief"), "id")
    sizes = volume.emergency(inputs, i15, None).select("id", "volume")
    table = chance.join(limit, "id").join(sizes, "id")
    return table.withColumn("hazard", hazard.hazard("likelihood", "volume").cast("int"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessment of the rasters derived from the test tables."""
    table = assess(grids.terrain(spark, sf_dir), grids.burn(spark, sf_dir), grids.soil(spark, sf_dir), stream_cells=40, i15=24.0, thresholds=(50, 100, 200))
    numbers = ("t", "f", "s", "likelihood", "volume", "threshold")
    return table.select("id", *(F.round(F.when(~F.isnan(c), F.col(c)), 4).alias(c) for c in numbers), "hazard")
