"""Flow of water over a terrain: directions, slopes, relief, accumulation and catchments.

Directions are numbered 1 to 8 anticlockwise from east; 0 is NoData. A cell's id is row * ncols + col.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projection as P
from ..functions import nodata as N
from ..functions.expr import NAN
from ..plans import tiles
from ..raster import Raster
from . import cells as ops

#: Direction: steps in rows and columns.
STEPS = {1: (0, 1), 2: (-1, 1), 3: (-1, 0), 4: (-1, -1), 5: (0, -1), 6: (1, -1), 7: (1, 0), 8: (1, 1)}
#: Of equally steep ways the first of these is taken.
TIES = (3, 2, 1, 8, 7, 6, 5, 4)


def cell_id(ncols: int, row="row", col="col") -> Column:
    return F.col(row).cast("bigint") * ncols + F.col(col)


def directions(dem: Raster) -> Raster:
    """The direction of steepest descent to a neighbour with data; 0 where there is none."""

    def steepest(window: tiles.Window) -> pa.Table:
        z = window.values("z")
        drop, best = np.zeros(z.shape), np.zeros(z.shape, np.int8)
        for d in TIES:
            dr, dc = STEPS[d]
            with np.errstate(invalid="ignore"):
                fall = (z - window.near(z, dr, dc, NAN)) / (math.sqrt(2) if dr and dc else 1.0)
            more = fall > drop
            drop[more], best[more] = fall[more], d
        return _table(window, window.there("z"), {"value": best})

    found = tiles.stencil({"z": dem.as_nan()}, tiles.Layout(dem.meta.shape, 1), steepest, "row int, col int, value tinyint")
    return Raster(found, dem.meta.update(dtype="int8", nodata=0))


def _table(window: tiles.Window, take: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """Rows, columns and values of a window's cells, its margin left out."""
    take = window.inner(take)
    row, col = window.places(take)
    arrays = [row.astype(np.int32), col.astype(np.int32), *(window.inner(a)[take] for a in columns.values())]
    return pa.table([pa.array(a) for a in arrays], names=["row", "col", *columns])


def arrows(flow: Raster, check: bool = False) -> DataFrame:
    """Cells of a flow raster, 0 where they have no direction."""
    if check:
        ops.require(flow, "flow")
    valid = N.data_mask("value", flow.meta.nodata) & F.col("value").between(1, 8)
    return flow.cells.select("row", "col", F.when(valid, F.col("value").cast("int")).otherwise(0).alias("value"))


def directed(window: tiles.Window, name: str = "flow") -> np.ndarray:
    """A window's directions, 0 where there is none."""
    return np.nan_to_num(window.values(name)).astype(np.int8)


def ahead(window: tiles.Window, dir: np.ndarray, array: np.ndarray, fill) -> np.ndarray:
    """For each cell with a direction what lies in the next one."""
    out = np.full_like(array, fill)
    for d, (dr, dc) in STEPS.items():
        at = dir == d
        out[at] = window.near(array, dr, dc, fill)[at]
    return out


def behind(window: tiles.Window, dir: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each cell the number of those that lead to it and for which an array is true."""
    out = np.zeros(dir.shape, np.int8)
    for d, (dr, dc) in STEPS.items():
        out += window.near(array & (dir == d), -dr, -dc, False)
    return out


def nodes(window: tiles.Window, dir: np.ndarray, take: np.ndarray) -> dict[str, pa.Array]:
    """``id``, ``down``, ``row`` and ``col`` of cells that arrays without margin tell; ``down`` is null where a path ends or leaves the raster."""
    row, col = window.places(take)
    nrows, ncols = window.layout.shape
    step = np.array([(0, 0), *(STEPS[d] for d in range(1, 9))])[dir[take]]
    to_row, to_col = row + step[:, 0], col + step[:, 1]
    on = (dir[take] > 0) & (to_row >= 0) & (to_row < nrows) & (to_col >= 0) & (to_col < ncols)
    return {"id": pa.array(row * ncols + col), "down": pa.array(to_row * ncols + to_col, mask=~on), "row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32))}


def steps(flow: Raster, check: bool = False) -> DataFrame:
    """``(id, row, col, down)`` of all cells, by no join: ``down`` is the next cell's id, be it a node or not; cells without a direction have a null id."""
    if check:
        ops.require(flow, "flow")
    nrows, ncols = flow.meta.shape
    valid = N.data_mask("value", flow.meta.nodata) & F.col("value").between(1, 8)
    table = flow.cells.select("row", "col", F.when(valid, F.col("value").cast("int")).alias("dir"))
    dr, dc = (F.element_at(F.array(*(F.lit(STEPS[d][k]) for d in range(1, 9))), F.col("dir")) for k in (0, 1))
    inside = (F.col("row") + dr).between(0, nrows - 1) & (F.col("col") + dc).between(0, ncols - 1)
    own = cell_id(ncols)
    return table.select(F.when(F.col("dir").isNotNull(), own).alias("id"), "row", "col", F.when(inside, own + dr * ncols + dc).alias("down"))


def slopes(dem: Raster, flow: Raster, dem_per_m: float = 1.0, check: bool = False) -> Raster:
    """Drop over distance to the next cell, with heights in units of ``dem_per_m`` to a metre; NaN where either cell has no data."""
    flow = dem.validate(flow, "flow")
    width, height = abs(dem.meta.grid.dx), abs(dem.meta.grid.dy)
    per_m = 1.0 if dem.meta.crs is None else P.y_units_per_m(dem.meta.crs)
    runs = np.array([NAN, *(math.hypot(width, height) if dr and dc else width if dc else height for dr, dc in (STEPS[d] for d in range(1, 9)))])

    def drops(window: tiles.Window) -> pa.Table:
        z, dir = window.values("z"), directed(window)
        with np.errstate(invalid="ignore"):
            value = (z - ahead(window, dir, z, NAN)) / dem_per_m / runs[dir] * per_m
        return _table(window, window.there("flow"), {"value": value})

    found = tiles.stencil({"flow": arrows(flow, check), "z": dem.as_nan()}, tiles.Layout(flow.meta.shape, 1), drops, "row int, col int, value double")
    return Raster(found, flow.meta.update(dtype="float64", nodata=NAN))


def relief(dem: Raster, flow: Raster, check: bool = False) -> Raster:
    """Drop from the highest ridge that drains here, the ridge's own drop not counted; 0 on ridges.

    A path's drops telescope, so this is the greatest height of a cell just below a ridge upstream, less
    the height of the next cell: one accumulation of a maximum.
    """
    flow = dem.validate(flow, "flow")

    def ridges(window: tiles.Window) -> pa.Table:
        z, dir = window.values("z"), directed(window)
        node = (dir > 0) & ~np.isnan(z)  # another cell is no part of any path
        dir = np.where(node, dir, 0).astype(np.int8)
        goes = ahead(window, dir, node, False)
        ridge = node & (behind(window, dir, goes) == 0)
        under = behind(window, dir, goes & ridge) > 0
        zd = ahead(window, dir, z, NAN)
        take = window.inner(window.there("flow"))
        found = nodes(window, window.inner(np.where(goes, dir, 0)), take)
        m = np.where(under & node, z, -np.inf)
        base = np.where(node, np.where(np.isnan(zd), z, zd), NAN)
        return pa.table(found | {n: pa.array(window.inner(a)[take]) for n, a in (("base", base), ("ridge", ridge), ("m", m))})

    forest = tiles.forest({"flow": arrows(flow, check), "z": dem.as_nan()}, tiles.Layout(flow.meta.shape, 2), ridges, "id bigint, down bigint, row int, col int, base double, ridge boolean, m double")
    value = F.when(F.col("ridge"), 0.0).when(F.isnan("base"), F.lit(NAN)).otherwise(F.col("m") - F.col("base"))
    found = tiles.upstream(forest, flow.meta.ncols, {"m": "max"}).select("row", "col", value.alias("value"))
    return Raster(found, flow.meta.update(dtype="float64", nodata=NAN))


def accumulation(flow: Raster, weights: Raster | None = None, mask: Raster | None = None, times: float = 1.0, omitnan: bool = False, check: bool = False) -> Raster:
    """Sum over each cell and all cells that drain to it: of ones or of weights, within a mask, times a factor.

    A weight without data makes all that follows NaN, or counts 0 with ``omitnan``. Cells without a direction are NaN.
    """
    given, masked = weights is not None, mask is not None
    grids = {"flow": arrows(flow, check)}
    if given:
        grids["w"] = flow.validate(weights, "weights").as_nan()
    if masked:
        grids["mask"] = flow.validate(mask, "mask").as_bool().cells

    def weighed(window: tiles.Window) -> pa.Table:
        dir, take = directed(window), window.there("flow")
        w = window.values("w") if given else np.ones(dir.shape)
        if masked:
            w = np.where(np.isnan(w) | (window.values("mask") == 1), w, 0.0)
        if omitnan:
            w = np.where(np.isnan(w), 0.0, w)
        w = np.where(dir > 0, w, NAN)
        return pa.table(nodes(window, dir, take) | {"w": pa.array(w[take])})

    forest = tiles.forest(grids, tiles.Layout(flow.meta.shape), weighed, "id bigint, down bigint, row int, col int, w double")
    rows = tiles.upstream(forest, flow.meta.ncols, {"w": "sum"}).select("row", "col", (F.col("w") * times).alias("value"))
    return Raster(rows, flow.meta.update(dtype="float64", nodata=NAN))


def catchment(flow: Raster, row: int, col: int, check: bool = False) -> Raster:
    """The cells that drain to one, itself included."""
    table = steps(flow, check).withColumn("hit", (F.col("row") == row) & (F.col("col") == col))
    found = tiles.downstream(table.where("id is not null"), flow.meta.ncols, {"hit": "either"}).select("row", "col", F.col("hit").alias("value"))
    rows = found.unionByName(table.where("id is null").select("row", "col", F.lit(False).alias("value")))
    return Raster(rows, flow.meta.update(dtype="bool", nodata=False))
