"""Rasters derived from the test tables, in the same arithmetic that SQL uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import NAN
from ..projection import Transform
from ..raster import Raster

PIXEL = 10.0
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row, col, v)``: the embeddings as a matrix."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return rows.select("row", "col", F.col("v").cast("double").alias("v"))


def _raster(cells: DataFrame, nrows: int, **meta) -> Raster:
    return Raster.from_cells(cells, nrows=nrows, ncols=WIDTH, transform=Transform(PIXEL, -PIXEL, 0, 0, 32611), **meta)


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def terrain(spark: SparkSession, sf_dir: str) -> Raster:
    """Whole heights that fall towards higher rows and the middle column."""
    z = (4 * (499 - F.col("row")) + 2 * F.abs(F.col("col") - 32) + F.floor(F.col("v") * 20)).cast("int")
    return _raster(matrix(spark, sf_dir).select("row", "col", z.alias("value")), rows_of(spark, sf_dir), dtype="int32", nodata=None, name="dem")


def burn(spark: SparkSession, sf_dir: str) -> Raster:
    """A burn ratio of -600 to 600 or so, NoData -999 in every 17th cell."""
    cells = matrix(spark, sf_dir)
    hole = F.pmod(F.col("row") * WIDTH + F.col("col"), F.lit(17)) == 0
    value = F.when(hole, -999).otherwise(F.floor(F.col("v") * 1000)).cast("int")
    return _raster(cells.select("row", "col", value.alias("value")), rows_of(spark, sf_dir), dtype="int32", nodata=-999, name="dnbr")


def soil(spark: SparkSession, sf_dir: str) -> Raster:
    """Positive soil values without NoData."""
    cells = matrix(spark, sf_dir)
    return _raster(cells.select("row", "col", (F.floor(F.abs(F.col("v")) * 100) + 10).cast("double").alias("value")), rows_of(spark, sf_dir), dtype="float64", nodata=NAN, name="soil")


SQL = f"""
g as (select vec_id::int as row, unnest(generate_series(0, {WIDTH - 1}))::int as col, unnest(embedding)::double as v from embeddings),
dem as materialized (select row, col, (4 * (499 - row) + 2 * abs(col - 32) + floor(v * 20))::int as z from g),
dnbr as materialized (select row, col, (case when (row * {WIDTH} + col) % 17 = 0 then -999 else floor(v * 1000) end)::int as value from g),
soil as materialized (select row, col, (floor(abs(v) * 100) + 10)::double as value from g),
dirs(dir, dr, dc, run, tie) as (values (1, 0, 1, 1.0::double, 2), (2, -1, 1, sqrt(2), 1), (3, -1, 0, 1.0, 0), (4, -1, -1, sqrt(2), 7), (5, 0, -1, 1.0, 6), (6, 1, -1, sqrt(2), 5), (7, 1, 0, 1.0, 4), (8, 1, 1, sqrt(2), 3)),
nb as (select a.row, a.col, d.dir, d.tie, (a.z - b.z) / d.run as fall from dem a cross join dirs d join dem b on b.row = a.row + d.dr and b.col = a.col + d.dc),
best as (select row, col, dir from (select *, row_number() over (partition by row, col order by fall desc, tie) as k from nb where fall > 0) where k = 1),
flow as materialized (select d.row, d.col, coalesce(b.dir, 0) as dir from dem d left join best b on d.row = b.row and d.col = b.col),
cells as materialized (select f.row::bigint * {WIDTH} + f.col as id, f.row, f.col, f.dir, f.row + d.dr as next_row, f.col + d.dc as next_col from flow f join dirs d on f.dir = d.dir),
edges as materialized (select c.*, n.id as down from cells c left join cells n on n.row = c.next_row and n.col = c.next_col)
"""
