"""Windows, buffers, clips, mosaics and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import projection as P
from ..errors import MissingNoDataError, OverlapError
from ..functions import nodata as N
from ..raster import Meta, Raster, grid_cells

RESAMPLINGS = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "min", "max", "med", "q1", "q3", "sum", "rms")


def _filled(cells: DataFrame, meta: Meta) -> Raster:
    """Cells laid on a full grid, NoData where there are none."""
    if meta.nodata is None:
        raise MissingNoDataError("cells outside the raster need a NoData value")
    kind = dict(cells.dtypes)["value"]
    grid = grid_cells(cells.sparkSession, *meta.shape)
    rows = grid.join(cells.withColumn("__there", F.lit(True)), ["row", "col"], "left")
    value = F.when(F.col("__there"), F.col("value")).otherwise(F.lit(meta.nodata).cast(kind))
    return Raster(rows.select("row", "col", value.alias("value")), meta)


def _window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of rows r0 to r1 and columns c0 to c1 (exclusive), numbered anew; the filter reaches the scan."""
    inside = cells.where(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
    return inside.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "value")


def sliced(raster: Raster, rows: slice, cols: slice) -> Raster:
    """A window of rows and columns."""
    meta = raster.meta.sliced(rows, cols)
    (r0, r1, _), (c0, c1, _) = rows.indices(raster.meta.nrows), cols.indices(raster.meta.ncols)
    return Raster(_window(raster.cells, r0, r1, c0, c1), meta)


def windowed(raster: Raster, bounds: P.Bounds) -> Raster:
    """The part within bounds that overlap the raster."""
    r0, r1, c0, c1 = raster.meta.limits(bounds)
    meta = raster.meta.window(bounds)
    r0, c0 = max(r0, 0), max(c0, 0)
    return Raster(_window(raster.cells, r0, r0 + meta.nrows, c0, c0 + meta.ncols), meta)


def buffer(raster: Raster, distance: float = 0, units: str = "meters", **edges: float) -> Raster:
    """Padded with NoData, by a distance or by one for each edge."""
    pixels = raster.meta.buffers(distance, units, edges)
    moved = raster.cells.select((F.col("row") + pixels["top"]).alias("row"), (F.col("col") + pixels["left"]).alias("col"), "value")
    return _filled(moved, raster.meta.buffered(pixels))


def clip(raster: Raster, bounds: P.Bounds) -> Raster:
    """Cut to bounds, or extended with NoData to reach them. Left and top are those of the bounds."""
    r0, r1, c0, c1 = raster.meta.limits(bounds)
    if r1 <= r0 or c1 <= c0:
        raise OverlapError("the bounds have no pixels")
    box = (bounds if P.compatible(bounds.crs, raster.meta.crs) else bounds.reproject(raster.meta.crs)).orient(raster.meta.grid.orientation)
    t = raster.meta.grid
    meta = raster.meta.update(nrows=r1 - r0, ncols=c1 - c0, transform=P.Transform(t.dx, t.dy, box.left, box.top, t.crs))
    cells = _window(raster.cells, r0, r1, c0, c1)
    if r0 >= 0 and c0 >= 0 and r1 <= raster.meta.nrows and c1 <= raster.meta.ncols:
        return Raster(cells, meta)
    return _filled(cells, meta)


def mosaic(tiles: list[Raster], bounds: P.Bounds | None = None) -> Raster:
    """Tiles of one grid joined; where they overlap the last one counts. Cells that no tile has are NoData."""
    first = tiles[0].meta
    if any(not P.compatible(t.meta.crs, first.crs) for t in tiles):
        raise OverlapError("the tiles have several coordinate reference systems")
    t = first.grid
    places = [(round((r.meta.grid.top - t.top) / t.dy), round((r.meta.grid.left - t.left) / t.dx), r.meta) for r in tiles]
    r0, c0 = min(p[0] for p in places), min(p[1] for p in places)
    r1, c1 = max(p[0] + p[2].nrows for p in places), max(p[1] + p[2].ncols for p in places)
    meta = first.update(nrows=r1 - r0, ncols=c1 - c0, transform=t.shifted(r0, c0))
    parts = [tile.cells.select((F.col("row") + (r - r0)).alias("row"), (F.col("col") + (c - c0)).alias("col"), "value", F.lit(k).alias("k")) for k, (tile, (r, c, _)) in enumerate(zip(tiles, places))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    out = _filled(rows.groupBy("row", "col").agg(F.max_by("value", "k").alias("value")), meta)
    return clip(out, bounds) if bounds is not None else out


def aligned(meta: Meta, target: P.Transform) -> Meta:
    """The grid of a transform that covers a raster, its edges moved outward to whole pixels of the target."""
    box = meta.bounds.reproject(target.crs) if not P.compatible(meta.crs, target.crs) else meta.bounds
    box = box.orient(target.orientation)
    left = target.left + math.floor((box.left - target.left) / target.dx + 1e-9) * target.dx
    top = target.top + math.floor((box.top - target.top) / target.dy + 1e-9) * target.dy
    ncols, nrows = math.ceil(abs((box.right - left) / target.dx) - 1e-9), math.ceil(abs((box.bottom - top) / target.dy) - 1e-9)
    return meta.update(nrows=nrows, ncols=ncols, transform=P.Transform(target.dx, target.dy, left, top, target.crs), crs=target.crs)


def _source_places(grid: DataFrame, target: Meta, source: Meta) -> DataFrame:
    """Target cells with the fractional row and column of their centres in the source."""
    x = target.grid.left + (F.col("col") + 0.5) * target.grid.dx
    y = target.grid.top + (F.col("row") + 0.5) * target.grid.dy
    if not P.compatible(source.crs, target.crs):
        x, y = P.reproject(x, y, target.crs, source.crs)
    return grid.select("row", "col", ((y - source.grid.top) / source.grid.dy).alias("v"), ((x - source.grid.left) / source.grid.dx).alias("u"))


def reproject(raster: Raster, template: Raster | Meta | None = None, *, crs=None, transform: P.Transform | None = None, resampling: str = "nearest") -> Raster:
    """Resampled to another grid: a template's, or that of a transform or coordinate system.

    Nearest takes the source pixel that holds a target centre; bilinear, cubic, cubic_spline and lanczos weigh the 4, 16, 16 or 36
    around it, leaving out NoData; the others summarise the source pixels whose centres lie in the target pixel.
    """
    if resampling not in RESAMPLINGS:
        raise ValueError(f"no resampling {resampling}; there are {', '.join(RESAMPLINGS)}")
    source = raster.ensure_nodata().meta
    if template is not None:
        other = template.meta if isinstance(template, Raster) else template
        transform, crs = transform or other.transform, crs or other.crs
    if transform is None:
        transform = source.grid.reproject(crs) if crs is not None and not P.compatible(source.crs, crs) else source.grid
    if crs is not None and transform.crs is None:
        transform = P.Transform(transform.dx, transform.dy, transform.left, transform.top, P.check(crs))
    target = aligned(source, transform)
    spark = raster.cells.sparkSession
    if resampling in ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos"):
        places = _source_places(grid_cells(spark, *target.shape), target, source)
        kind = dict(raster.cells.dtypes)["value"]
        cells = raster.cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
        if resampling == "nearest":
            placed = places.select("row", "col", F.floor("v").cast("int").alias("sr"), F.floor("u").cast("int").alias("sc"))
            out = placed.join(cells, ["sr", "sc"], "left").select("row", "col", F.coalesce("value", F.lit(source.nodata).cast(kind)).alias("value"))
            return Raster(out, target)
        reach = {"bilinear": 1, "lanczos": 3}.get(resampling, 2)
        steps = F.array(*(F.lit(k) for k in range(1 - reach, reach + 1)))
        near = places.select("row", "col", (F.col("v") - 0.5).alias("v"), (F.col("u") - 0.5).alias("u"))
        near = near.withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
        near = near.select("row", "col", (F.floor("v") + F.col("a")).cast("int").alias("sr"), (F.floor("u") + F.col("b")).cast("int").alias("sc"), "v", "u")

        def weight(d):
            d = F.abs(d)
            if resampling == "bilinear":
                return F.greatest(F.lit(0.0), 1 - d)
            if resampling == "cubic_spline":
                return F.when(d <= 1, (4 - 6 * d * d + 3 * d * d * d) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)
            if resampling == "lanczos":
                wave = math.pi * d
                return F.when(d < 1e-12, 1.0).when(d < 3, 3 * F.sin(wave) * F.sin(wave / 3) / (wave * wave)).otherwise(0.0)
            return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)

        down, across = weight(F.col("v") - F.col("sr")), weight(F.col("u") - F.col("sc"))
        data = cells.where(N.data_mask("value", source.nodata))
        weighed = near.join(data, ["sr", "sc"]).select("row", "col", F.struct("sr", "sc", (F.col("value") * down * across).alias("s"), (down * across).alias("w")).alias("x"))
        # summed up row by row, so that no sum depends on the order in which cells arrive
        inside = weighed.groupBy("row", "col").agg(F.sort_array(F.collect_list("x")).alias("x"))
        total = lambda name: F.aggregate("x", F.lit(0.0), lambda t, x: t + x[name]).alias(name)
        summed = inside.select("row", "col", total("s"), total("w")).where("abs(w) > 1e-9")
        out = summed.select("row", "col", (F.col("s") / F.col("w")).alias("value"))
        return _filled(out, target.update(dtype="float64", nodata=N.default("float64")))
    x = source.grid.left + (F.col("col") + 0.5) * source.grid.dx
    y = source.grid.top + (F.col("row") + 0.5) * source.grid.dy
    if not P.compatible(source.crs, target.crs):
        x, y = P.reproject(x, y, source.crs, target.crs)
    r, c = target.grid.rowcol(x, y)
    data = raster.cells.where(N.data_mask("value", source.nodata)).select(r.alias("row"), c.alias("col"), F.col("value").cast("double").alias("value"))
    aggregates = {
        "average": F.avg("value"),
        "mode": F.mode("value", True),
        "min": F.min("value"),
        "max": F.max("value"),
        "med": F.percentile("value", 0.5),
        "q1": F.percentile("value", 0.25),
        "q3": F.percentile("value", 0.75),
        "sum": F.sum("value"),
        "rms": F.sqrt(F.avg(F.col("value") * F.col("value"))),
    }
    out = data.groupBy("row", "col").agg(aggregates[resampling].alias("value"))
    return _filled(out, target.update(dtype="float64", nodata=N.default("float64")))
