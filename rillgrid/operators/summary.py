"""Statistics of rasters over segments and their catchments, and the variables of hazard models.

Every cell is labelled once with the first segment outlet on its way. A catchment is then a segment's own
cells and those of the segments above it, so statistics of catchments are one aggregation of cells to segments and partial
sums up the forest of the much smaller table of segments. Medians need the cells themselves and the closure of the forest.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units as U
from ..functions.expr import INF, NAN
from ..plans import doubling as D
from ..plans import tables, tiles
from ..raster import Raster
from .cells import require
from .network import Network, cell_segments, outlets

STATISTICS = ("outlet", "min", "max", "mean", "median", "std", "sum", "var", "nanmin", "nanmax", "nanmean", "nanmedian", "nanstd", "nansum", "nanvar")


def statistic(name: str, value="value", ord="ord") -> Column:
    """An aggregate of doubles with NaN for NoData; without the prefix 'nan' any NaN makes it NaN. No data gives NaN."""
    if name not in STATISTICS:
        raise ValueError(f"no statistic {name}; there are {', '.join(STATISTICS)}")
    x = F.col(value) if isinstance(value, str) else value
    if name == "outlet":
        return F.max_by(x, F.col(ord))
    data = F.when(~F.isnan(x), x)
    plain = name.removeprefix("nan")
    out = {"min": F.min, "max": F.max, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_pop, "sum": F.sum, "var": F.var_pop}[plain](data)
    if name == plain:
        out = F.when(F.max(F.isnan(x).cast("int")) == 1, F.lit(NAN)).otherwise(out)
    return F.coalesce(out, F.lit(NAN))


def summary(network: Network, name: str, raster: Raster) -> DataFrame:
    """``(id, value)``: a statistic of a raster over each segment's own pixels."""
    table = _at(network, network.pixels.withColumnRenamed("id", "value"), network.flow.validate(raster).as_nan(), network.pixels.withColumnRenamed("ord", "value") if name == "outlet" else None)
    return table.groupBy("id").agg(statistic(name).alias("value"))


def _at(network: Network, places: DataFrame, values: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``(id, value)`` where ids ``places(row, col, value)`` lie on a raster's cells, with ``ord`` if an order of places is given."""
    grids = {"id": places, "value": values} | ({} if order is None else {"ord": order})
    return tiles.beside({n: g.select("row", "col", "value") for n, g in grids.items()}, network.meta.shape).drop("row", "col")


def at_outlets(network: Network, raster: Raster, terminal: bool = False) -> DataFrame:
    """``(id, value)`` at each outlet."""
    found = _at(network, outlets(network).withColumnRenamed("id", "value"), network.flow.validate(raster).as_nan())
    return _scope(network, network.segments.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(NAN)).alias("value")), terminal)


def _scope(network: Network, table: DataFrame, terminal: bool) -> DataFrame:
    return table.join(network.segments.where("child is null").select("id"), "id", "left_semi") if terminal else table


_KEPT: dict[tuple[int, str], tuple[Network, DataFrame]] = {}


def _kept(network: Network, name: str, make) -> DataFrame:
    """A table about a network that all statistics of it share, worked out once; the last few networks' are known."""
    key = (id(network), name)
    if key not in _KEPT:
        _KEPT[key] = (network, make())
        while len(_KEPT) > 16:
            _KEPT.pop(next(iter(_KEPT)))
    return _KEPT[key][1]


def forget() -> None:
    """Drops the tables that statistics of networks share."""
    _KEPT.clear()


def labelled(network: Network) -> DataFrame:
    """``cell_segments`` of a network, as a written table."""
    return _kept(network, "labels", lambda: tables.write(cell_segments(network), f"{tables.folder(network.pixels.sparkSession)}/labels"))


def closure(network: Network) -> DataFrame:
    """``(id, descendant)`` of a network's segments; its steps are written tables already."""
    return _kept(network, "closure", lambda: D.closure(network.forest()))


def _cells(network: Network, rasters: dict[str, Raster], mask: Raster | None) -> DataFrame:
    """Labelled cells with the rasters' values, within a mask."""
    table = labelled(network)
    if not rasters and mask is None:
        return table
    grids = {"id": table.withColumnRenamed("id", "value")} | {column: network.flow.validate(raster, column).as_nan() for column, raster in rasters.items()}
    if mask is not None:
        grids["__mask"] = network.flow.validate(mask, "mask").as_bool().cells.where("value")
    return tiles.beside(grids, network.meta.shape).drop("__mask")


_FOLDS = {"nans": "sum", "s": "sum", "lo": "min", "hi": "max"}
#: What stands for the parts of no cells.
_NOTHING = {"n": 0, "mean": 0.0, "m2": 0.0, "nans": 0, "s": 0.0, "lo": INF, "hi": -INF}


def _partial(x: Column, alias: str) -> list[Column]:
    """What a segment's own cells give: count, mean and squares, NaNs, sum and extremes. Null cells are no part of it."""
    data = F.when(~F.isnan(x), x)
    found = {"n": F.count(data), "mean": F.avg(data), "m2": F.var_pop(data) * F.count(data), "nans": F.sum(F.isnan(x).cast("long")), "s": F.sum(data), "lo": F.min(data), "hi": F.max(data)}
    return [c.alias(f"{alias}_{p}") for p, c in found.items()]


def _upstream(network: Network, by_segment: DataFrame, columns: list[str]) -> DataFrame:
    """The parts of each segment and all segments above it, by folding the forest of segments."""
    table = network.forest().join(by_segment, "id", "left")
    table = table.withColumns({f"{c}_{p}": F.coalesce(F.col(f"{c}_{p}"), F.lit(nothing).cast("long" if p in ("n", "nans") else "double")) for c in columns for p, nothing in _NOTHING.items()})
    return network.upstream(table, {f"{c}_{p}": how for c in columns for p, how in _FOLDS.items()}, tuple(columns))


def _final(name: str, alias: str) -> Column:
    n, m2, nans, s, lo, hi = (F.col(f"{alias}_{p}") for p in ("n", "m2", "nans", "s", "lo", "hi"))
    plain = name.removeprefix("nan")
    out = {"min": lo, "max": hi, "mean": s / n, "sum": s, "var": m2 / n, "std": F.sqrt(m2 / n)}[plain]
    out = F.when(n == 0, F.lit(NAN)).otherwise(out)
    return out if name != plain else F.when(nans > 0, F.lit(NAN)).otherwise(out)


def catchment_summaries(network: Network, wanted: dict[str, tuple[str, Raster]], mask: Raster | None = None, terminal: bool = False) -> DataFrame:
    """``(id, ..)``: several statistics of catchments in one pass; ``wanted[column]`` is a statistic and a raster.

    All but the median and the outlet are merged from sums, extremes and counts by segment.
    """
    if any(s in ("median", "nanmedian", "outlet") for s, _ in wanted.values()):
        parts = [catchment_summary(network, s, r, mask, terminal).withColumnRenamed("value", c) for c, (s, r) in wanted.items()]
        return reduce(lambda a, b: a.join(b, "id"), parts)
    table = _cells(network, {c: r for c, (_, r) in wanted.items()}, mask)
    by_segment = table.groupBy("id").agg(*(p for c in wanted for p in _partial(F.col(c), c)))
    out = _upstream(network, by_segment, list(wanted)).select("id", *(_final(s, c).alias(c) for c, (s, _) in wanted.items()))
    return _scope(network, out, terminal)


def catchment_summary(network: Network, name: str, raster: Raster, mask: Raster | None = None, terminal: bool = False) -> DataFrame:
    """``(id, value)``: a statistic of a raster over the cells that drain to each segment, within a mask."""
    if name not in STATISTICS:
        raise ValueError(f"no statistic {name}; there are {', '.join(STATISTICS)}")
    if name == "outlet":
        return at_outlets(network, raster, terminal)
    if name in ("median", "nanmedian"):
        below = closure(network)
        cells = _cells(network, {"value": raster}, mask)
        found = below.join(cells, "id").groupBy(F.col("descendant").alias("id")).agg(statistic(name).alias("value"))
        return _scope(network, network.segments.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(NAN)).alias("value")), terminal)
    return catchment_summaries(network, {"value": (name, raster)}, mask, terminal)


def pixel_counts(network: Network, mask: Raster | None = None, terminal: bool = False) -> DataFrame:
    """``(id, value)``: number of cells in each catchment, within a mask."""
    by_segment = _cells(network, {}, mask).groupBy("id").agg(F.count("*").alias("value"))
    table = network.forest().join(by_segment, "id", "left").withColumn("value", F.coalesce("value", F.lit(0).cast("bigint")))
    return _scope(network, network.upstream(table, {"value": "sum"}).select("id", "value"), terminal)


def area(network: Network, mask: Raster | None = None, units: str = "kilometers", terminal: bool = False) -> DataFrame:
    """``(id, value)``: catchment area, within a mask."""
    size = network.meta.pixel_area("meters") * U.factor("meters", units) ** 2 if U.standardize(units) != "base" else network.meta.pixel_area("base")
    return pixel_counts(network, mask, terminal).select("id", (F.col("value") * size).alias("value"))


def catchment_ratio(network: Network, mask: Raster, terminal: bool = False) -> DataFrame:
    """``(id, value)``: share of each catchment within a mask."""
    inside = pixel_counts(network, mask, terminal).withColumnRenamed("value", "n")
    return pixel_counts(network, None, terminal).join(inside, "id").select("id", F.when(F.col("value") > 0, F.col("n") / F.col("value")).otherwise(F.lit(NAN)).alias("value"))


burn_ratio = catchment_ratio


def burned_area(network: Network, isburned: Raster, units: str = "kilometers", terminal: bool = False) -> DataFrame:
    return area(network, isburned, units, terminal)


developed_area = burned_area


def in_mask(network: Network, mask: Raster, terminal: bool = False) -> DataFrame:
    """``(id, value)``: whether any of a segment's pixels is in a mask."""
    inside = network.flow.validate(mask, "mask").as_bool().cells
    return _scope(network, _at(network, network.pixels.withColumnRenamed("id", "value"), inside).groupBy("id").agg(F.bool_or("value").alias("value")), terminal)


in_perimeter = in_mask


def _mean(network: Network, raster: Raster, mask: Raster | None, omitnan: bool, terminal: bool) -> DataFrame:
    return catchment_summary(network, "nanmean" if omitnan else "mean", raster, mask, terminal)


def kf_factor(network: Network, kf: Raster, mask: Raster | None = None, terminal: bool = False, omitnan: bool = False) -> DataFrame:
    """``(id, value)``: mean soil erodibility, which must be positive."""
    return _mean(network, require(kf, "positive"), mask, omitnan, terminal)


def scaled_dnbr(network: Network, dnbr: Raster, mask: Raster | None = None, terminal: bool = False, omitnan: bool = False) -> DataFrame:
    """``(id, value)``: mean differenced burn ratio over 1000."""
    return _mean(network, dnbr, mask, omitnan, terminal).withColumn("value", F.col("value") / 1000)


def scaled_thickness(network: Network, thickness: Raster, mask: Raster | None = None, terminal: bool = False, omitnan: bool = False) -> DataFrame:
    """``(id, value)``: mean soil thickness over 100; it must be positive."""
    return _mean(network, require(thickness, "positive"), mask, omitnan, terminal).withColumn("value", F.col("value") / 100)


def sine_theta(network: Network, sines: Raster, mask: Raster | None = None, terminal: bool = False, omitnan: bool = False) -> DataFrame:
    """``(id, value)``: mean sine of the slope, which lies in [0, 1]."""
    return _mean(network, require(sines, "inrange", low=0, high=1), mask, omitnan, terminal)


def slope(network: Network, slopes: Raster, terminal: bool = False, omitnan: bool = False) -> DataFrame:
    """``(id, value)``: mean slope along the segment itself."""
    return _scope(network, summary(network, "nanmean" if omitnan else "mean", slopes), terminal)


def relief(network: Network, relief: Raster, terminal: bool = False) -> DataFrame:
    return at_outlets(network, relief, terminal)


def ruggedness(network: Network, relief: Raster, relief_per_m: float = 1.0, terminal: bool = False) -> DataFrame:
    """``(id, value)``: relief over the square root of the catchment's area, in metres."""
    size = area(network, None, "meters", terminal).withColumnRenamed("value", "a")
    return at_outlets(network, relief, terminal).join(size, "id").select("id", (F.col("value") / relief_per_m / F.sqrt("a")).alias("value"))


def _ones(mask: Raster) -> Raster:
    """1 within a mask and 0 elsewhere, so that its mean over a catchment is the share within."""
    return mask.as_bool().with_value(F.col("value").cast("double"), dtype="float64", nodata=NAN)


def _steep(slopes: Raster, burned: Raster, degrees: float) -> Raster:
    """1 in burned cells at least so steep, 0 in others, those without a slope among them."""
    limit = math.tan(math.radians(degrees))
    rows = tiles.beside({"s": slopes.as_nan(), "b": slopes.validate(burned, "burned").as_bool().cells}, slopes.meta.shape)
    value = (F.col("b") & ~F.isnan("s") & (F.col("s") >= limit)).cast("double")
    return Raster(rows.select("row", "col", value.alias("value")), slopes.meta.update(dtype="float64", nodata=NAN))


def _within(raster: Raster, mask: Raster) -> Raster:
    """The raster's cells within a mask; those outside are null, which no statistic counts."""
    rows = tiles.beside({"v": raster.as_nan(), "__in": raster.validate(mask, "mask").as_bool().cells}, raster.meta.shape)
    return Raster(rows.select("row", "col", F.when(F.col("__in"), F.col("v")).alias("value")), raster.meta.update(dtype="float64", nodata=NAN))


def _means(network: Network, t: Raster, f: Raster, s: Raster, omitnan: str) -> DataFrame:
    """``(id, t, f, s)``: means over catchments, in one pass; NaNs are left out of those that ``omitnan`` names."""
    return catchment_summaries(network, {c: ("nanmean" if c in omitnan else "mean", r) for c, r in (("t", t), ("f", f), ("s", s))})


def m1_variables(network: Network, moderate_high: Raster, slopes: Raster, dnbr: Raster, kf: Raster, omitnan: bool = False) -> DataFrame:
    """``(id, t, f, s)``: share burned and steeper than 23 degrees, scaled burn ratio, erodibility."""
    found = _means(network, _steep(slopes, moderate_high, 23), dnbr, require(kf, "positive"), "fs" if omitnan else "")
    return found.select("id", "t", (F.col("f") / 1000).alias("f"), "s")


def m2_variables(network: Network, moderate_high: Raster, slopes: Raster, dnbr: Raster, kf: Raster, omitnan: bool = False) -> DataFrame:
    """``(id, t, f, s)``: mean sine of the slope where burned, scaled burn ratio, erodibility."""
    sines = Raster(slopes.as_nan("v").select("row", "col", F.sin(F.atan("v")).alias("value")), slopes.meta.update(dtype="float64", nodata=NAN))
    found = _means(network, _within(sines, moderate_high), dnbr, require(kf, "positive"), "tfs" if omitnan else "")
    return found.select("id", "t", (F.col("f") / 1000).alias("f"), "s")


def m3_variables(network: Network, moderate_high: Raster, relief: Raster, thickness: Raster, relief_per_m: float = 1.0, omitnan: bool = False) -> DataFrame:
    """``(id, t, f, s)``: ruggedness, share burned, scaled soil thickness."""
    ones = _ones(moderate_high)
    found = catchment_summaries(network, {"t": ("sum", Raster(ones.cells.withColumn("value", F.lit(1.0)), ones.meta)), "f": ("mean", ones), "s": ("nanmean" if omitnan else "mean", require(thickness, "positive"))})
    size = F.col("t") * network.meta.pixel_area("meters")
    table = found.join(at_outlets(network, relief), "id")
    return table.select("id", (F.col("value") / relief_per_m / F.sqrt(size)).alias("t"), "f", (F.col("s") / 100).alias("s"))


def m4_variables(network: Network, isburned: Raster, slopes: Raster, dnbr: Raster, thickness: Raster, omitnan: bool = False) -> DataFrame:
    """``(id, t, f, s)``: share burned and steeper than 30 degrees, scaled burn ratio, scaled soil thickness."""
    found = _means(network, _steep(slopes, isburned, 30), dnbr, require(thickness, "positive"), "fs" if omitnan else "")
    return found.select("id", "t", (F.col("f") / 1000).alias("f"), (F.col("s") / 100).alias("s"))


#: Direction: the two half-windows across it, as steps of rows and columns.
_ACROSS = {1: ((1, 0), (-1, 0)), 5: ((-1, 0), (1, 0)), 3: ((0, 1), (0, -1)), 7: ((0, -1), (0, 1)), 2: ((1, 1), (-1, -1)), 6: ((-1, -1), (1, 1)), 4: ((-1, 1), (1, -1)), 8: ((1, -1), (-1, 1))}


def confinement(network: Network, dem: Raster, neighborhood: int, dem_per_m: float = 1.0) -> DataFrame:
    """``(id, value)``: confinement angle in degrees, 180 less the mean angles up to the highest cell on either side.

    Each stream pixel looks at the heights of up to ``neighborhood`` cells to either side of its flow, within its tile's margin. NaN if a
    pixel has no direction or a cell looked at no data.
    """
    dem = network.flow.validate(dem, "dem")
    w, h = dem.meta.resolution("meters") if dem.meta.crs is not None else (abs(dem.meta.grid.dx), abs(dem.meta.grid.dy))

    def sides(window: tiles.Window) -> pa.Table:
        z, there = window.values("z"), window.there("z")
        flow = window.values("flow")
        take = window.inner(window.there("id") & window.there("flow") & there)
        found = {"id": pa.array(window.inner(window.values("id"))[take].astype(np.int64)), "dir": pa.array(window.inner(np.where((flow >= 1) & (flow <= 8), flow, 0))[take].astype(np.int32)), "z": pa.array(window.inner(z)[take])}
        for side in (0, 1):
            top, seen = np.full(z.shape, -np.inf), np.zeros(z.shape, bool)
            for d, two in _ACROSS.items():
                at = flow == d
                dr, dc = two[side]
                for k in range(1, neighborhood + 1):
                    has = at & window.near(there, k * dr, k * dc, False)
                    top[has] = np.maximum(top, window.near(z, k * dr, k * dc, NAN))[has]
                    seen |= has
            found[f"top{side}"] = pa.array(window.inner(top)[take], mask=~window.inner(seen)[take])
        return pa.table(found)

    grids = {"id": network.pixels.select("row", "col", F.col("id").alias("value")), "flow": network.flow.cells, "z": dem.as_nan()}
    pixels = tiles.stencil(grids, tiles.Layout(dem.meta.shape, neighborhood), sides, "id bigint, dir int, z double, top0 double, top1 double")
    run = F.when(F.col("dir").isin(1, 5), h).when(F.col("dir").isin(3, 7), w).otherwise(math.hypot(w, h)) * neighborhood * dem_per_m
    a, b = (F.avg(F.atan((F.col(f"top{k}") - F.col("z")) / run)) for k in (0, 1))
    value = F.when(F.min("dir") == 0, F.lit(NAN)).otherwise(F.coalesce(180 - F.degrees(a + b), F.lit(NAN)))
    return pixels.groupBy("id").agg(value.alias("value"))
