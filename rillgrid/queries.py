"""Registered queries over the test tables, with the SQL that DuckDB answers them by."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection as P
from .functions import classes as C
from .functions import formats, hazard, likelihood, nodata, rainfall, slope, units, volume
from .operators import cells, condition, features, flow, network, spatial, summary
from .plans import assessment, grids, tables
from .plans.grids import PIXEL, WIDTH
from .projection import Bounds
from .raster import Raster
from .sources import geotiff

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}
DIGITS = 6


def _add(name: str, query: Query, sql: str | Callable[[], str] | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _out(raster: Raster) -> DataFrame:
    return raster.cells.select("row", "col", "value")


def _r(column, digits: int = DIGITS):
    return F.round(column, digits)


# --- scalars -------------------------------------------------------------------------------------
def _lines(s, d):
    return grids.table(s, d, "lineitem")


_add(
    "slope_conversions",
    lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", *(_r(f("l_discount")).alias(n) for n, f in (("percent", slope.to_percent), ("radians", slope.to_radians), ("degrees", slope.to_degrees), ("sine", slope.to_sine), ("back_percent", lambda c: slope.from_percent(F.col(c) * 100)), ("from_radians", slope.from_radians), ("from_degrees", lambda c: slope.from_degrees(F.col(c) * 100)), ("from_sine", slope.from_sine)))),
    "select l_orderkey, l_linenumber, round(l_discount * 100, 6) as percent, round(atan(l_discount), 6) as radians, round(degrees(atan(l_discount)), 6) as degrees, round(sin(atan(l_discount)), 6) as sine, round(l_discount * 100 / 100, 6) as back_percent, round(tan(l_discount), 6) as from_radians, round(tan(radians(l_discount * 100)), 6) as from_degrees, round(tan(asin(l_discount)), 6) as from_sine from lineitem",
)
_add(
    "unit_convert",
    lambda s, d: _lines(s, d).select("l_orderkey", "l_linenumber", *(_r(units.convert("l_quantity", a, b)).alias(f"{a}_{b}") for a, b in (("feet", "meters"), ("miles", "kilometers"), ("meters", "feet"), ("kilometers", "miles")))),
    "select l_orderkey, l_linenumber, round(l_quantity * 0.3048, 6) as feet_meters, round(l_quantity * 1.609344, 6) as miles_kilometers, round(l_quantity / 0.3048, 6) as meters_feet, round(l_quantity / 1.609344, 6) as kilometers_miles from lineitem",
)
_add(
    "intensity_to_accumulation",
    lambda s, d: rainfall.with_durations(_lines(s, d).select("l_orderkey", "l_linenumber", "l_quantity"), [15, 30, 60]).select("l_orderkey", "l_linenumber", F.col("duration").cast("int").alias("duration"), _r(rainfall.to_accumulation("l_quantity", "duration")).alias("accumulation")),
    "select l_orderkey, l_linenumber, duration, round(l_quantity * duration / 60, 6) as accumulation from lineitem, (values (15), (30), (60)) t(duration)",
)
_add(
    "intensity_from_accumulation",
    lambda s, d: rainfall.with_durations(_lines(s, d).select("l_orderkey", "l_linenumber", "l_quantity"), [15, 30, 60]).select("l_orderkey", "l_linenumber", F.col("duration").cast("int").alias("duration"), _r(rainfall.from_accumulation("l_quantity", "duration")).alias("intensity")),
    "select l_orderkey, l_linenumber, duration, round(l_quantity * 60 / duration, 6) as intensity from lineitem, (values (15), (30), (60)) t(duration)",
)
_add("haversine", lambda s, d: grids.table(s, d, "customer").select("c_custkey", _r(P.haversine(F.lit(-118.0), F.lit(34.0), -118 + F.col("c_nationkey") / 10, 34 + F.col("c_acctbal") / 1e4), 3).alias("meters")), "select c_custkey, round(2 * 6371000.0::double * atan2(sqrt(h), sqrt(1 - h)), 3) as meters from (select c_custkey, pow(sin(radians(c_acctbal / 1e4) / 2), 2) + cos(radians(34)) * cos(radians(34 + c_acctbal / 1e4)) * pow(sin(radians(c_nationkey / 10) / 2), 2) as h from customer)")
_add(
    "utm_zone",
    lambda s, d: grids.table(s, d, "customer").select("c_custkey", P.utm_code(F.pmod("c_custkey", F.lit(360)) - 180, F.col("c_acctbal") / 120).alias("epsg")),
    "select c_custkey, case when y <= 84 and y >= -80 then (case when y >= 72 and x >= 0 and x < 9 then 31 when y >= 72 and x >= 9 and x < 21 then 33 when y >= 72 and x >= 21 and x < 33 then 35 when y >= 72 and x >= 33 and x < 42 then 37 when y >= 56 and y < 64 and x >= 3 and x < 12 then 32 else floor((x + 180) / 6) + 1 end + case when y >= 0 then 32600 else 32700 end)::int end as epsg from (select c_custkey, c_custkey % 360 - 180 as x, c_acctbal / 120 as y from customer)",
)


def _round_trip(s, d):
    x, y = P.reproject(-117 + F.col("c_nationkey") / 10, 30 + F.col("c_acctbal") / 1e3, 4326, 32611)
    moved = grids.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", x.alias("x"), y.alias("y"))
    lon, lat = P.reproject("x", "y", 32611, 4326)
    return moved.select("c_custkey", _r(lon).alias("lon"), _r(lat).alias("lat"))


_add("reproject_round_trip", _round_trip, "select c_custkey, round(-117 + c_nationkey / 10, 6) as lon, round(30 + c_acctbal / 1e3, 6) as lat from customer")
_add("driver_extensions", lambda s, d: formats.extensions(s, "raster").unionByName(formats.extensions(s, "vector")), "select * from (values " + ", ".join(f"('{e}', '{name}')" for kind in formats.TABLES.values() for name, own in kind.items() for e in own) + ") t(extension, driver)")
_add("formats", lambda s, d: formats.table(s).select("kind", "driver", F.array_join("extensions", ", ").alias("extensions")), "select * from (values " + ", ".join(f"('{k}', '{name}', '{', '.join(own)}')" for k, kind in formats.TABLES.items() for name, own in kind.items()) + ") t(kind, driver, extensions)")
_add("driver_of_path", lambda s, d: grids.table(s, d, "part").select("p_partkey", formats.driver_of(F.concat(F.lit("/a.b/x."), F.element_at(F.array(*map(F.lit, ("tif", "TIFF", "img", "zzz"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))), "raster").alias("driver")), "select p_partkey, case p_partkey % 4 when 0 then 'GTiff' when 1 then 'GTiff' when 2 then 'HFA' end as driver from part")
_add("slugs", lambda s, d: grids.table(s, d, "part").select("p_partkey", formats.slug(F.col("p_name")).alias("slug")), r"select p_partkey, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9\s-]', '', 'g')), '[\s-]+', '-', 'g') as slug from part")

# --- cells ---------------------------------------------------------------------------------------
_G = f"with recursive {grids.SQL} "
_add("raster_grid", lambda s, d: _out(grids.terrain(s, d)), f"{_G} select row, col, z as value from dem")
_add("raster_fill", lambda s, d: _out(cells.fill(grids.burn(s, d), 0)), f"{_G} select row, col, case when value = -999 then 0 else value end as value from dnbr")
_add("raster_find", lambda s, d: _out(cells.find(grids.burn(s, d), [-999, 5, 17])), f"{_G} select row, col, value in (-999, 5, 17) as value from dnbr")
_add("raster_set_range_clamp", lambda s, d: _out(cells.set_range(grids.burn(s, d), -100, 200)), f"{_G} select row, col, case when value = -999 then value else greatest(-100, least(200, value)) end as value from dnbr")
_add("raster_set_range_fill", lambda s, d: _out(cells.set_range(grids.burn(s, d), -100, 200, fill=True, exclude_bounds=True)), f"{_G} select row, col, case when value > -100 and value < 200 then value else -999 end as value from dnbr")
_add("nodata_mask", lambda s, d: _out(grids.burn(s, d).nodata_mask), f"{_G} select row, col, value = -999 as value from dnbr")
_add("data_mask", lambda s, d: _out(grids.burn(s, d).data_mask), f"{_G} select row, col, value <> -999 as value from dnbr")
_add("default_nodata", lambda s, d: s.createDataFrame([(t, float(nodata.default(t))) for t in ("int8", "int16", "uint8", "bool")], "dtype string, nodata double"), "select * from (values ('int8', -128.0::double), ('int16', -32768.0), ('uint8', 255.0), ('bool', 0.0)) t(dtype, nodata)")
_add("severity_estimate", lambda s, d: _out(cells.severity_estimate(grids.burn(s, d))), f"{_G} select row, col, (case when value = -999 then 0 when value <= 125 then 1 when value <= 250 then 2 when value <= 500 then 3 else 4 end)::tinyint as value from dnbr")
_add("severity_mask", lambda s, d: _out(cells.severity_mask(cells.severity_estimate(grids.burn(s, d)), ["moderate", "high"])), f"{_G} select row, col, value > 250 as value from dnbr")
_add("classify_bins", lambda s, d: grids.burn(s, d).cells.select("row", "col", C.classify("value", [-50, 0, 50], -999.0, -1).alias("value")), f"{_G} select row, col, case when value = -999 then -1 when value <= -50 then 1 when value <= 0 then 2 when value <= 50 then 3 else 4 end as value from dnbr")
_add("mask_and", lambda s, d: _out(cells.combine(grids.burn(s, d).data_mask, cells.find(grids.terrain(s, d), list(range(0, 2000, 2))), "and")), f"{_G} select row, col, n.value <> -999 and z % 2 = 0 and z between 0 and 1998 as value from dnbr n join dem using (row, col)")
_add("mask_or", lambda s, d: _out(cells.combine(grids.burn(s, d).nodata_mask, cells.find(grids.terrain(s, d), list(range(0, 2000, 2))), "or")), f"{_G} select row, col, n.value = -999 or (z % 2 = 0 and z between 0 and 1998) as value from dnbr n join dem using (row, col)")
_add("validate_inrange", lambda s, d: cells.failures(grids.burn(s, d), "inrange", low=-300, high=300), f"{_G} select row, col, value from dnbr where value <> -999 and (value < -300 or value > 300)")
_add("validate_positive", lambda s, d: cells.failures(grids.burn(s, d), "positive"), f"{_G} select row, col, value from dnbr where value <> -999 and value <= 0")
_add("validate_boolean", lambda s, d: cells.failures(grids.burn(s, d), "boolean"), f"{_G} select row, col, value from dnbr where value not in (-999, 0, 1)")
_add("raster_equals", lambda s, d: s.createDataFrame([(grids.burn(s, d).equals(grids.burn(s, d)), grids.burn(s, d).equals(cells.fill(grids.burn(s, d), 0)))], "same boolean, other boolean"), "select true as same, false as other")
_add("raster_rows", lambda s, d: grids.terrain(s, d).to_rows().select("row", F.aggregate("values", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("values").alias("n")), f"{_G} select row, sum(z)::bigint as total, count(*)::int as n from dem group by row")

# --- space ---------------------------------------------------------------------------------------
_BOX = Bounds(40, -400, 300, -100, 32611)
_add("raster_slice", lambda s, d: _out(spatial.sliced(grids.terrain(s, d), slice(10, 40), slice(5, 60))), f"{_G} select row - 10 as row, col - 5 as col, z as value from dem where row between 10 and 39 and col between 5 and 59")
_add("raster_window", lambda s, d: _out(spatial.windowed(grids.burn(s, d), Bounds(-100, -400, 300, 50, 32611))), f"{_G} select row, col, value from dnbr where row < 40 and col < 30")
_add("raster_clip_interior", lambda s, d: _out(spatial.clip(grids.burn(s, d), _BOX)), f"{_G} select row - 10 as row, col - 4 as col, value from dnbr where row between 10 and 39 and col between 4 and 29")
_add("raster_clip_exterior", lambda s, d: _out(spatial.clip(grids.burn(s, d), Bounds(-50, -200, 100, 30, 32611))), f"{_G} select g.r::int as row, g.c::int as col, coalesce(value, -999) as value from (select r, c from range(0, 23) a(r), range(0, 15) b(c)) g left join dnbr on row = g.r - 3 and col = g.c - 5")
_add("raster_buffer", lambda s, d: _out(spatial.buffer(grids.burn(s, d), 25, "meters", left=11)), f"{_G} select g.r::int as row, g.c::int as col, coalesce(value, -999) as value from (select r, c from range(0, (select max(row) + 7 from dnbr)) a(r), range(0, {WIDTH + 5}) b(c)) g left join dnbr on row = g.r - 3 and col = g.c - 2")


def _tiles(s, d):
    base = grids.burn(s, d)
    return _out(spatial.mosaic([spatial.sliced(base, slice(0, 20), slice(0, 20)), cells.fill(spatial.sliced(base, slice(10, 40), slice(10, 30)), 7).override(nodata=-999)]))


_add("raster_mosaic", _tiles, f"{_G} select g.r::int as row, g.c::int as col, coalesce(case when g.r >= 10 and g.c >= 10 then (case when value = -999 then 7 else value end) when g.r < 20 and g.c < 20 then value end, -999) as value from (select r, c from range(0, 40) a(r), range(0, 30) b(c)) g left join dnbr on row = g.r and col = g.c")
_COARSE = P.Transform(4 * PIXEL, -4 * PIXEL, 0, 0, 32611)
_GROUPS = f"{_G} select row // 4 as row, col // 4 as col, {{}} as value from dem group by 1, 2"


def _coarse(s, d, how):
    """The cells that have a value: those of the last row may have none, as the coarse grid reaches beyond a terrain whose rows aren't a multiple of four."""
    r = spatial.reproject(grids.terrain(s, d), transform=_COARSE, resampling=how)
    return r.cells.where(nodata.data_mask("value", r.meta.nodata)).select("row", "col", _r(F.col("value").cast("double")).alias("value"))


for _how, _agg in (("average", "round(avg(z), 6)"), ("min", "min(z)::double"), ("max", "max(z)::double"), ("med", "round(quantile_cont(z, 0.5), 6)::double"), ("sum", "sum(z)::double"), ("q1", "round(quantile_cont(z, 0.25), 6)::double"), ("q3", "round(quantile_cont(z, 0.75), 6)::double"), ("rms", "round(sqrt(avg(z::double * z)), 6)")):
    _add(f"resample_{_how}", lambda s, d, how=_how: _coarse(s, d, how), _GROUPS.format(_agg))
_add("resample_mode", lambda s, d: _coarse(s, d, "mode"), f"{_G} select row, col, z::double as value from (select row // 4 as row, col // 4 as col, z, row_number() over (partition by row // 4, col // 4 order by count(*) desc, z) as k from dem group by row // 4, col // 4, z) where k = 1")
_add("resample_nearest", lambda s, d: _coarse(s, d, "nearest"), f"{_G} select row // 4 as row, col // 4 as col, z::double as value from dem where row % 4 = 2 and col % 4 = 2")
_add("resample_bilinear", lambda s, d: _coarse(s, d, "bilinear"), f"{_G} select row // 4 as row, col // 4 as col, round(avg(z), 6) as value from dem where row % 4 in (1, 2) and col % 4 in (1, 2) group by 1, 2")


#: Weights by distance of the kernels, for centres that lie half way between those of four pixels.
for _how, _w in (("cubic", {0.5: 0.5625, 1.5: -0.0625}), ("cubic_spline", {0.5: 23 / 48, 1.5: 1 / 48})):
    _span = "case when {0} % 4 in (1, 2) then " + repr(_w[0.5]) + "::double else " + repr(_w[1.5]) + "::double end"
    _weight = f"({_span.format('row')}) * ({_span.format('col')})"
    _add(f"resample_{_how}", lambda s, d, how=_how: _coarse(s, d, how), f"{_G} select row // 4 as row, col // 4 as col, round(sum(z * {_weight}) / sum({_weight}), 6) as value from dem group by 1, 2")


def _moved(s, d):
    """Cells of the terrain placed in the equal-area projection and back, by way of the geographic system and Web Mercator."""
    t = grids.terrain(s, d)
    x, y = 400_000 + (F.col("col") + 0.5) * PIXEL, 3_800_000 - (F.col("row") + 0.5) * PIXEL
    table = t.cells.select("row", "col", x.alias("x0"), y.alias("y0"))
    for k, (a, b) in enumerate(((32611, 5070), (5070, 3857), (3857, 4269), (4269, 26911))):
        x, y = P.reproject(f"x{k}", f"y{k}", a, b)
        table = table.withColumn(f"x{k + 1}", x).withColumn(f"y{k + 1}", y)
    return table.select("row", "col", _r("x4", 2).alias("x"), _r("y4", 2).alias("y"))


_add("reproject_systems", _moved, f"{_G} select row, col, round(400000 + (col + 0.5) * {PIXEL}, 2)::double as x, round(3800000 - (row + 0.5) * {PIXEL}, 2)::double as y from dem")
_add("segment_relief", lambda s, d: _stat(summary.relief(_network(s, d), grids.soil(s, d))), lambda: f"{_NET} select id, value from seg join soil on row = end_row and col = end_col")


def _files(s, d):
    """The burn ratio written as GeoTIFFs and a window of it read again."""
    path = f"{tables.folder(s)}/burn"
    geotiff.write(grids.burn(s, d), path, rows_per_file=128)
    return _out(geotiff.read(s, path, bounds=Bounds(100, -2000, 400, -500, 32611)))


_add("geotiff_window", _files, f"{_G} select row - 50 as row, col - 10 as col, value from dnbr where row between 50 and 199 and col between 10 and 39")


def _points(s, d):
    p = grids.table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.pmod(F.col("c_custkey") * 37, F.lit(640)) + 0.5).alias("x"), (-F.pmod(F.col("c_custkey") * 53, F.lit(900)) - 0.5).alias("y"), F.col("c_nationkey").alias("v"))
    return _out(features.rasterize_points(p, "v", (90, 64), P.Transform(10, -10, 0, 0, 32611), order="id", dtype="int32"))


_add("rasterize_points", _points, "select g.r::int as row, g.c::int as col, coalesce(v, -2147483648) as value from (select r, c from range(0, 90) a(r), range(0, 64) b(c)) g left join (select floor(((c_custkey * 53) % 900 + 0.5) / 10)::int as pr, floor(((c_custkey * 37) % 640 + 0.5) / 10)::int as pc, arg_max(c_nationkey, c_custkey) as v from customer group by 1, 2) on pr = g.r and pc = g.c")


def _boxes(s, d):
    x, y = (F.pmod(F.col("s_suppkey") * 41, F.lit(500))).cast("double"), -(F.pmod(F.col("s_suppkey") * 67, F.lit(700))).cast("double")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(83, 0), corner(83, -57), corner(0, -57), corner(0, 0))
    p = grids.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(ring).alias("rings"), F.col("s_nationkey").alias("v"))
    return _out(features.rasterize_polygons(p, "v", (90, 64), P.Transform(10, -10, 0, 0, 32611), order="id", dtype="int32"))


_add("rasterize_polygons", _boxes, "select g.r::int as row, g.c::int as col, coalesce(arg_max(s_nationkey, s_suppkey), -2147483648) as value from (select r, c from range(0, 90) a(r), range(0, 64) b(c)) g left join supplier on g.c * 10 + 5 >= (s_suppkey * 41) % 500 and g.c * 10 + 5 < (s_suppkey * 41) % 500 + 83 and g.r * 10 + 5 >= (s_suppkey * 67) % 700 and g.r * 10 + 5 < (s_suppkey * 67) % 700 + 57 group by 1, 2")
_add("window_features", lambda s, d: features.within(grids.table(s, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(640)).cast("double").alias("x"), (-F.pmod(F.col("c_custkey") * 3, F.lit(900))).cast("double").alias("y")), Bounds(100, -500, 300, -50)), "select c_custkey, (c_custkey % 640)::double as x, (-((c_custkey * 3) % 900))::double as y from customer where c_custkey % 640 between 100 and 300 and (c_custkey * 3) % 900 between 50 and 500")

# --- flow ----------------------------------------------------------------------------------------


_KEPT: dict[tuple, object] = {}


def _state(s, d) -> tuple:
    """The files of the tables that rasters are derived from, with their times and sizes."""
    place = s._jvm.org.apache.hadoop.fs.Path(f"{d}/embeddings.parquet")
    fs = place.getFileSystem(s._jsc.hadoopConfiguration())
    files = fs.listStatus(place)
    return tuple((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files)


def _kept(s, d, name, make):
    """Base tables that many queries share (flow, slopes, the network) are written once for a session and the files they come from."""
    key = (s.sparkContext.applicationId, d, name, _state(s, d))
    if key not in _KEPT:
        made = make()
        _KEPT[key] = Raster(tables.write(made.cells, f"{tables.folder(s)}/{name}"), made.meta) if isinstance(made, Raster) else made
    return _KEPT[key]


def forget() -> None:
    """Drops what queries share, so that the next one works anew."""
    _KEPT.clear()
    summary.forget()


def _flow(s, d):
    return _kept(s, d, "flow", lambda: flow.directions(grids.terrain(s, d)))


def _slopes(s, d):
    return _kept(s, d, "slopes", lambda: flow.slopes(grids.terrain(s, d), _flow(s, d)))


def _values(raster, digits=DIGITS):
    return raster.cells.select("row", "col", _r(F.when(~F.isnan("value"), F.col("value")), digits).alias("value"))


def _mask(s, d):
    return cells.find(grids.terrain(s, d), []).with_value(F.pmod(F.col("row") + F.col("col"), F.lit(2)) == 0)


_UP = f"{_G}, up(anc, id) as (select id, id from edges union all select u.anc, e.down from up u join edges e on u.id = e.id where e.down is not null)"
_add("d8_flow", lambda s, d: _out(flow.directions(grids.terrain(s, d))), f"{_G} select row, col, dir::tinyint as value from flow")
_add("validate_flow", lambda s, d: cells.failures(_flow(s, d).override(nodata=None), "flow"), f"{_G} select row, col, dir::tinyint as value from flow where dir = 0")
_add("d8_slopes", lambda s, d: _values(flow.slopes(grids.terrain(s, d), _flow(s, d))), f"{_G} select f.row, f.col, round((a.z - b.z) / (r.run * {PIXEL}), 6) as value from flow f join dem a using (row, col) left join dirs r on f.dir = r.dir left join dem b on b.row = f.row + r.dr and b.col = f.col + r.dc")
_add("accumulation", lambda s, d: _values(flow.accumulation(_flow(s, d))), f"{_UP} select f.row, f.col, n::double as value from flow f left join (select id, count(*) as n from up group by id) on id = f.row::bigint * {WIDTH} + f.col")
_add("accumulation_area", lambda s, d: _values(flow.accumulation(_flow(s, d), times=PIXEL * PIXEL)), f"{_UP} select f.row, f.col, n::double * 100 as value from flow f left join (select id, count(*) as n from up group by id) on id = f.row::bigint * {WIDTH} + f.col")
_add("accumulation_weighted", lambda s, d: _values(flow.accumulation(_flow(s, d), grids.soil(s, d))), f"{_UP} select f.row, f.col, n as value from flow f left join (select up.id, sum(value) as n from up join edges e on up.anc = e.id join soil s using (row, col) group by up.id) on id = f.row::bigint * {WIDTH} + f.col")
_add("accumulation_masked", lambda s, d: _values(flow.accumulation(_flow(s, d), grids.soil(s, d), _mask(s, d))), f"{_UP} select f.row, f.col, n as value from flow f left join (select up.id, sum(case when (row + col) % 2 = 0 then value else 0 end) as n from up join edges e on up.anc = e.id join soil s using (row, col) group by up.id) on id = f.row::bigint * {WIDTH} + f.col")
_add("accumulation_omitnan", lambda s, d: _values(flow.accumulation(_flow(s, d), grids.burn(s, d), omitnan=True)), f"{_UP} select f.row, f.col, n::double as value from flow f left join (select up.id, sum(case when value = -999 then 0 else value end) as n from up join edges e on up.anc = e.id join dnbr s using (row, col) group by up.id) on id = f.row::bigint * {WIDTH} + f.col")
_add("accumulation_nodata", lambda s, d: _values(flow.accumulation(_flow(s, d), grids.burn(s, d))), f"{_UP} select f.row, f.col, n::double as value from flow f left join (select up.id, case when bool_or(value = -999) then null else sum(value) end as n from up join edges e on up.anc = e.id join dnbr s using (row, col) group by up.id) on id = f.row::bigint * {WIDTH} + f.col")
_add(
    "relief",
    lambda s, d: _values(flow.relief(grids.terrain(s, d), _flow(s, d))),
    f"{_UP}, ridge as (select id from edges where id not in (select down from edges where down is not null)), top as (select up.id, max(z) as m from up join (select distinct e.down from edges e join ridge using (id) where e.down is not null) c on up.anc = c.down join edges e on e.id = c.down join dem using (row, col) group by up.id) select f.row, f.col, case when e.id is null then null when r.id is not null then 0 else (t.m - coalesce(zd.z, d.z))::double end as value from flow f join dem d using (row, col) left join edges e on e.row = f.row and e.col = f.col left join ridge r on r.id = e.id left join top t on t.id = e.id left join dem zd on zd.row = e.next_row and zd.col = e.next_col",
)
_add("catchment_mask", lambda s, d: _out(flow.catchment(_flow(s, d), 40, 32)), f"{_UP} select f.row, f.col, coalesce(hit, false) as value from flow f left join (select anc, true as hit from up where id = 40 * {WIDTH} + 32 group by anc) on anc = f.row::bigint * {WIDTH} + f.col")
_add("fill_pits", lambda s, d: _values(condition.fill_pits(grids.terrain(s, d))), f"{_G}, low as (select a.row, a.col, min(b.z) as low from dem a cross join dirs d join dem b on b.row = a.row + d.dr and b.col = a.col + d.dc group by 1, 2) select row, col, (case when row between 1 and (select max(row) - 1 from dem) and col between 1 and {WIDTH - 2} and z < low then low else z end)::double as value from dem join low using (row, col)")


#: Every cell's level falls to its fixed point in as many rounds as a way to the border has cells, at most.
_FILL_ROUNDS = 160
_add(
    "fill_depressions",
    lambda s, d: _values(condition.fill_depressions(grids.terrain(s, d))),
    f"{_G}, rim as (select row, col, z, row in (0, (select max(row) from dem)) or col in (0, {WIDTH - 1}) as out from dem), wet(k, row, col, z, w) as (select 0, row, col, z, case when out then z else 1000000 end from rim union all select wet.k + 1, wet.row, wet.col, any_value(wet.z), least(any_value(wet.w), greatest(any_value(wet.z), min(n.w))) from wet join dirs d on true join wet n on n.row = wet.row + d.dr and n.col = wet.col + d.dc where wet.k < {_FILL_ROUNDS} group by wet.k, wet.row, wet.col) select row, col, w::double as value from wet where k = {_FILL_ROUNDS}",
)
_add("resolve_flats", lambda s, d: _values(condition.resolve_flats(condition.fill_depressions(grids.terrain(s, d)))))

# --- networks ------------------------------------------------------------------------------------
STREAM = 10


def _network(s, d):
    return _kept(s, d, "network", lambda: _new_network(s, d))


def _new_network(s, d):
    f = _flow(s, d)
    streams = flow.accumulation(f)
    return network.build(f, streams.with_value(~F.isnan("value") & (F.col("value") >= STREAM), dtype="bool", nodata=False))


_NET = f"""{_UP}, acc as materialized (select id, count(*) as n from up group by id),
node as materialized (select e.* from edges e join acc using (id) where n >= {STREAM}),
fed as (select b.id, count(*) as k, min(a.id) as u from node a join node b on a.down = b.id group by b.id),
st as materialized (select n.*, coalesce(k, 0) as k from node n left join fed using (id)),
walk(head, id, ord) as (select id, id, 0 from st where k <> 1 union all select w.head, b.id, w.ord + 1 from walk w join st a on w.id = a.id join st b on a.down = b.id where b.k = 1),
pix as materialized (select head + 1 as id, ord, row, col, next_row, next_col, st.id as cell, down from walk join st using (id)),
seg as materialized (select p.id, c.id as child, p.row as end_row, p.col as end_col, p.ord + 1 as n_pixels, p.cell as end_cell from (select *, row_number() over (partition by id order by ord desc) as k from pix) p left join pix c on p.down = c.cell where p.k = 1)"""
_DOWN = f"{_NET}, below(id, dst) as (select id, id from seg union all select b.id, s.child from below b join seg s on b.dst = s.id where s.child is not null)"


def _ids(table, *columns):
    return table.select("id", *columns)


_add("network_heads", lambda s, d: (n := _network(s, d)).segments.select("id").join(network.parents(n), "id", "left_anti"), f"{_NET} select id from seg where id not in (select child from seg where child is not null)")
_add("network_links", lambda s, d: _new_network(s, d).segments.select("id", "child", "end_row", "end_col", F.col("n_pixels").cast("bigint").alias("n_pixels")), f"{_NET} select id, child, end_row, end_col, n_pixels::bigint as n_pixels from seg")
_add("segment_pixels", lambda s, d: _network(s, d).pixels.select("id", F.col("ord").cast("int").alias("ord"), "row", "col"), f"{_NET} select id, ord::int as ord, row, col from pix")
_add("segment_length", lambda s, d: network.lengths(_network(s, d)).select("id", _r("length").alias("length")), f"{_NET} select id, round(sum({PIXEL} * sqrt(pow(next_row - row, 2) + pow(next_col - col, 2))), 6) as length from pix group by id")
_add("outlets", lambda s, d: network.outlets(_network(s, d)), f"{_NET} select id, end_row as row, end_col as col from seg")
_add("terminal_outlets", lambda s, d: network.outlets(_network(s, d), terminal=True), f"{_DOWN} select b.id, s.end_row as row, s.end_col as col from below b join seg s on b.dst = s.id where s.child is null")
_add("isterminal", lambda s, d: network.is_terminal(_network(s, d)), f"{_NET} select id, child is null as is_terminal from seg")
_add("termini", lambda s, d: network.termini(_network(s, d)).select("id", "terminus"), f"{_DOWN} select b.id, b.dst as terminus from below b join seg s on b.dst = s.id where s.child is null")
_add("parents", lambda s, d: network.parents(_network(s, d)), f"{_NET} select child as id, id as parent from seg where child is not null")
_add("child", lambda s, d: network.children(_network(s, d)), f"{_NET} select id, child from seg where child is not null")
_add("ancestors", lambda s, d: network.ancestors(_network(s, d)), f"{_DOWN} select dst as id, id as ancestor from below where id <> dst")
_add("descendents", lambda s, d: network.descendents(_network(s, d)), f"{_DOWN} select id, dst as descendent from below where id <> dst")
_add("family", lambda s, d: network.family(_network(s, d)).groupBy("terminus").agg(F.count("*").alias("n")), f"{_DOWN} select b.dst as terminus, count(*) as n from below b join seg s on b.dst = s.id where s.child is null group by b.dst")
_add("continuous_filter", lambda s, d: network.continuous(n := _network(s, d), n.segments.where("id % 3 <> 0").select("id")), f"{_DOWN} select id from seg s where not (id % 3 = 0 and ((select bool_and(dst % 3 = 0) from below b where b.id = s.id) or (select bool_and(b.id % 3 = 0) from below b where b.dst = s.id)))")
_add("remove_segments", lambda s, d: network.remove(n := _network(s, d), n.segments.where("id % 3 = 0").select("id")).segments.select("id", "child"), f"{_NET} select id, case when child % 3 <> 0 then child end as child from seg where id % 3 <> 0")
_add("stream_raster", lambda s, d: _out(network.stream_raster(_network(s, d))), f"{_NET} select f.row, f.col, coalesce(id, 0) as value from flow f left join pix using (row, col)")
_BASINS = f"{_NET}, term as (select end_cell, id from seg where child is null), last(anc, dst, label, k) as (select e.id, e.id, t.id, 0 from edges e left join term t on t.end_cell = e.id union all select l.anc, e.down, coalesce(t.id, l.label), l.k + 1 from last l join edges e on l.dst = e.id left join term t on t.end_cell = e.down where e.down is not null), basin as materialized (select anc, arg_max(label, k) as label from last where label is not null group by anc)"
_add("basins_raster", lambda s, d: _out(network.basin_raster(_network(s, d))), f"{_BASINS} select f.row, f.col, coalesce(label, 0) as value from flow f left join basin on anc = f.row::bigint * {WIDTH} + f.col")
_add("isnested", lambda s, d: network.is_nested(_network(s, d)), f"{_BASINS}, below(id, dst) as (select id, id from seg union all select b.id, s.child from below b join seg s on b.dst = s.id where s.child is not null) select b.id, label <> b.dst as is_nested from below b join seg s on b.dst = s.id and s.child is null join basin on anc = s.end_cell")

# --- summaries -----------------------------------------------------------------------------------
_STAT = {"min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "std": "stddev_pop(v)", "sum": "sum(v)", "var": "var_pop(v)"}
_VALUES = "case when value <> -999 then value::double end"


def _stat_sql(name: str) -> str:
    plain = name.removeprefix("nan")
    found = _STAT[plain]
    return f"round({found if plain != name else f'case when count(*) = count(v) then {found} end'}, {4 if plain in ('std', 'var') else EXACT})"


#: Digits of results that are quotients of sums of whole numbers, the same in any engine; a tie of rounding lies beyond.
EXACT = 10


def _stat(table, digits=EXACT):
    return table.select("id", _r(F.when(~F.isnan("value"), F.col("value")), digits).alias("value"))


def _raised(s, d):
    """The burn ratio a hundred million up, where squares have lost the difference."""
    base = grids.burn(s, d)
    return base.with_value(F.when(F.col("value") != -999, F.col("value") + 100_000_000.0).otherwise(-999.0), dtype="float64")


for _name in ("var", "nanvar", "nanstd"):
    _add(f"catchment_summary_{_name}_raised", lambda s, d, n=_name: _stat(summary.catchment_summary(_network(s, d), n, _raised(s, d)), 4 if n.endswith("std") else 2), f"{_NET} select s.id, {_stat_sql(_name).replace(', 4)', ', 2)') if _name.endswith('var') else _stat_sql(_name)} as value from seg s join (select up.id, {_VALUES} as v from up join edges e on up.anc = e.id join dnbr using (row, col)) c on c.id = s.end_cell group by s.id")
for _name in summary.STATISTICS[1:]:
    _add(f"segment_summary_{_name}", lambda s, d, n=_name: _stat(summary.summary(_network(s, d), n, grids.burn(s, d)), 4 if n.endswith(("std", "var")) else EXACT), f"{_NET} select id, {_stat_sql(_name)} as value from (select id, {_VALUES} as v from pix join dnbr using (row, col)) group by id")
    _add(f"catchment_summary_{_name}", lambda s, d, n=_name: _stat(summary.catchment_summary(_network(s, d), n, grids.burn(s, d)), 4 if n.endswith(("std", "var")) else EXACT), f"{_NET} select s.id, {_stat_sql(_name)} as value from seg s join (select up.id, {_VALUES} as v from up join edges e on up.anc = e.id join dnbr using (row, col)) c on c.id = s.end_cell group by s.id")
_add("segment_summary_outlet", lambda s, d: _stat(summary.summary(_network(s, d), "outlet", grids.burn(s, d))), f"{_NET} select id, {_VALUES} as value from seg join dnbr on row = end_row and col = end_col")
_add("catchment_summary_outlet", lambda s, d: _stat(summary.catchment_summary(_network(s, d), "outlet", grids.burn(s, d))), f"{_NET} select id, {_VALUES} as value from seg join dnbr on row = end_row and col = end_col")
_CATCH = f"{_NET} select s.id, {{}} as value from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join dnbr b using (row, col) join soil so using (row, col) join flow f using (row, col) join dem d using (row, col) group by s.id"
_add("area", lambda s, d: summary.area(_network(s, d), None).select("id", _r("value").alias("value")), _CATCH.format(f"round(count(*) * {PIXEL * PIXEL / 1e6}::double, 6)"))
_add("area_terminal", lambda s, d: summary.area(_network(s, d), None, "meters", terminal=True).select("id", _r("value").alias("value")), f"{_NET} select s.id, round(count(*) * {PIXEL * PIXEL}::double, 6) as value from seg s join up on up.id = s.end_cell where s.child is null group by s.id")


def _burned(s, d):
    return cells.severity_mask(cells.severity_estimate(grids.burn(s, d), (50, 100, 200)), "burned")


_add("burned_area", lambda s, d: summary.burned_area(_network(s, d), _burned(s, d), "meters").select("id", _r("value").alias("value")), _CATCH.format(f"round(count(*) filter (b.value > 50) * {PIXEL * PIXEL}::double, 6)"))
_add("burn_ratio", lambda s, d: summary.burn_ratio(_network(s, d), _burned(s, d)).select("id", _r("value").alias("value")), _CATCH.format("round(count(*) filter (b.value > 50) / count(*), 6)"))
_add("in_mask", lambda s, d: summary.in_mask(_network(s, d), _burned(s, d)), f"{_NET} select id, bool_or(value > 50) as value from pix join dnbr using (row, col) group by id")
_add("kf_factor", lambda s, d: summary.kf_factor(_network(s, d), grids.soil(s, d)).select("id", _r("value", 10).alias("value")), _CATCH.format("round(avg(so.value), 10)"))
_add("scaled_dnbr", lambda s, d: _stat(summary.scaled_dnbr(_network(s, d), grids.burn(s, d), omitnan=True)), _CATCH.format("round(avg(b.value) filter (b.value <> -999) / 1000, 10)"))
_add("scaled_thickness", lambda s, d: _stat(summary.scaled_thickness(_network(s, d), grids.soil(s, d))), _CATCH.format("round(avg(so.value) / 100, 10)"))
_SLOPE = "(select a.row, a.col, (a.z - b.z) / (r.run * 10.0) as slope from flow f join dem a using (row, col) join dirs r on f.dir = r.dir join dem b on b.row = f.row + r.dr and b.col = f.col + r.dc)"
_add("sine_theta", lambda s, d: (lambda sl: _stat(summary.sine_theta(_network(s, d), sl.with_value(F.sin(F.atan("value")))), 6))(_slopes(s, d)), f"{_NET} select s.id, round(avg(sin(atan(slope))), 6) as value from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join {_SLOPE} x using (row, col) group by s.id")
_add("segment_slope", lambda s, d: _stat(summary.slope(_network(s, d), _slopes(s, d)), 6), f"{_NET} select id, round(avg(slope), 6) as value from pix join {_SLOPE} x using (row, col) group by id")
_add("ruggedness", lambda s, d: _stat(summary.ruggedness(_network(s, d), grids.soil(s, d), 2.0)), f"{_NET} select s.id, round(max(so.value) / 2 / sqrt(count(*) * 100), 10) as value from seg s join up on up.id = s.end_cell join soil so on so.row = s.end_row and so.col = s.end_col group by s.id")
_add(
    "m1_variables",
    lambda s, d: summary.m1_variables(_network(s, d), _burned(s, d), _slopes(s, d), grids.burn(s, d), grids.soil(s, d), omitnan=True).select("id", *(_r(c, 10).alias(c) for c in "tfs")),
    f"{_NET} select s.id, round(count(*) filter (b.value > 50 and slope >= {math.tan(math.radians(23))!r}) / count(*), 10) as t, round(avg(b.value) filter (b.value <> -999) / 1000, 10) as f, round(avg(so.value), 10) as s from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join dnbr b using (row, col) join soil so using (row, col) join {_SLOPE} x using (row, col) group by s.id",
)
_add("m2_variables", lambda s, d: summary.m2_variables(_network(s, d), _burned(s, d), _slopes(s, d), grids.burn(s, d), grids.soil(s, d), omitnan=True).select("id", *(_r(F.when(~F.isnan(c), F.col(c)), 6 if c == "t" else 10).alias(c) for c in "tfs")), f"{_NET} select s.id, round(avg(sin(atan(slope))) filter (b.value > 50), 6) as t, round(avg(b.value) filter (b.value <> -999) / 1000, 10) as f, round(avg(so.value), 10) as s from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join dnbr b using (row, col) join soil so using (row, col) join {_SLOPE} x using (row, col) group by s.id")
_add("m3_variables", lambda s, d: summary.m3_variables(_network(s, d), _burned(s, d), grids.soil(s, d), grids.soil(s, d)).select("id", *(_r(c, 10).alias(c) for c in "tfs")), f"{_NET} select s.id, round(max(o.value) / sqrt(count(*) * 100), 10) as t, round(count(*) filter (b.value > 50) / count(*), 10) as f, round(avg(so.value) / 100, 10) as s from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join dnbr b using (row, col) join soil so using (row, col) join soil o on o.row = s.end_row and o.col = s.end_col group by s.id")
_add("m4_variables", lambda s, d: summary.m4_variables(_network(s, d), _burned(s, d), _slopes(s, d), grids.burn(s, d), grids.soil(s, d), omitnan=True).select("id", *(_r(c, 10).alias(c) for c in "tfs")), f"{_NET} select s.id, round(count(*) filter (b.value > 50 and slope >= {math.tan(math.radians(30))!r}) / count(*), 10) as t, round(avg(b.value) filter (b.value <> -999) / 1000, 10) as f, round(avg(so.value) / 100, 10) as s from seg s join up on up.id = s.end_cell join edges e on up.anc = e.id join dnbr b using (row, col) join soil so using (row, col) join {_SLOPE} x using (row, col) group by s.id")
_ACROSS = ", ".join(f"({d}, {k}, {dr}, {dc})" for d, two in summary._ACROSS.items() for k, (dr, dc) in enumerate(two))
_add(
    "confinement",
    lambda s, d: _stat(summary.confinement(_network(s, d), grids.terrain(s, d), 4), 6),
    f"{_NET}, ac(dir, side, dr, dc) as (values {_ACROSS}), near as (select p.id, p.row, p.col, side, max(b.z) as top, any_value(a.z) as z, any_value(case when f.dir % 2 = 1 then {PIXEL}::double else sqrt({2 * PIXEL * PIXEL}) end * 4) as run from pix p join flow f using (row, col) join dem a using (row, col) join ac on ac.dir = f.dir cross join range(1, 5) k(k) join dem b on b.row = p.row + k.k * ac.dr and b.col = p.col + k.k * ac.dc group by p.id, p.row, p.col, side) select s.id, round(180 - degrees(avg(atan((top - z) / run)) filter (side = 0) + avg(atan((top - z) / run)) filter (side = 1)), 6) as value from seg s left join near using (id) group by s.id",
)

# --- models --------------------------------------------------------------------------------------
_VARS = "vars as materialized (select o_orderkey as id, avg(l_discount) as t, avg(l_tax) as f, avg(l_quantity) / 50 as s from orders join lineitem on o_orderkey = l_orderkey group by 1)"


def _variables(s, d):
    joined = grids.table(s, d, "orders").join(_lines(s, d), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_orderkey").alias("id")).agg(F.avg("l_discount").alias("t"), F.avg("l_tax").alias("f"), (F.avg("l_quantity") / 50).alias("s"))


def _params(model: str) -> str:
    return f"(values {', '.join(str(p) for p in likelihood.parameters(model))}) p(duration, b, ct, cf, cs)"


_add("s_parameters", lambda s, d: likelihood.parameter_table(s).select("model", "duration", "b", "ct", "cf", "cs"), " union all ".join(f"select '{m}' as model, duration, b::double as b, ct::double as ct, cf::double as cf, cs::double as cs from {_params(m)}" for m in likelihood.PARAMETERS))
for _m in likelihood.PARAMETERS:
    _add(f"likelihood_{_m.lower()}", lambda s, d, m=_m: likelihood.likelihoods(_variables(s, d), [3.0, 7.5], m).select("id", "r", "duration", _r("likelihood").alias("likelihood")), f"with {_VARS} select id, r, duration, round(exp(x) / (1 + exp(x)), 6) as likelihood from (select id, r, duration, b + (ct * t + cf * f + cs * s) * r as x from vars, {_params(_m)}, (values (3.0::double), (7.5)) q(r))")
    _add(f"threshold_{_m.lower()}", lambda s, d, m=_m: likelihood.accumulations(_variables(s, d), [0.5, 0.75], m).select("id", "p", "duration", _r("accumulation", 4).alias("accumulation"), _r("intensity", 4).alias("intensity")), f"with {_VARS} select id, q.p, duration, round(x, 4) as accumulation, round(x * 60 / duration, 4) as intensity from (select id, q.p, duration, (ln(q.p / (1 - q.p)) - b) / (ct * t + cf * f + cs * s) as x from vars, {_params(_m)}, (values (0.5::double), (0.75)) q(p)) q")


def _basins(s, d):
    return grids.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 1000).alias("bmh"), (F.pmod("s_suppkey", F.lit(900)) + 50).cast("double").alias("relief"), (F.pmod("s_suppkey", F.lit(7)) / 10).alias("bt"), (F.pmod("s_suppkey", F.lit(5)) + 1).cast("double").alias("years"), (F.pmod("s_suppkey", F.lit(11)) + 0.5).alias("area"))


_BSQL = "b as materialized (select s_suppkey as id, abs(s_acctbal) / 1000 as bmh, (s_suppkey % 900 + 50)::double as relief, (s_suppkey % 7) / 10 as bt, (s_suppkey % 5 + 1)::double as years, (s_suppkey % 11) + 0.5::double as area from supplier)"
_HALF = {n: volume.multiplier(0.95, v["rse"]) for n, v in (("e", volume.EMERGENCY), ("l", volume.LONGTERM))}
_LN = "case when {0} = 0 then '-inf'::double else ln({0}) end"
_add("volume_emergency", lambda s, d: volume.emergency(_basins(s, d), [16.0, 40.0]).select("id", "i15", *(_r(c, 4).alias(c) for c in ("volume", "volume_min", "volume_max"))), f"with {_BSQL} select id, i15, round(exp(x), 4) as volume, round(exp(x - {_HALF['e']!r}), 4) as volume_min, round(exp(x + {_HALF['e']!r}), 4) as volume_max from (select id, i15, 4.22 + 0.39 * sqrt(i15) + 0.36 * {_LN.format('bmh')} + 0.13 * sqrt(relief) as x from b, (values (16.0::double), (40.0)) t(i15))")
_add("volume_longterm", lambda s, d: volume.longterm(_basins(s, d), [16.0, 40.0]).select("id", "i60", *(_r(c, 4).alias(c) for c in ("volume", "volume_min", "volume_max"))), f"with {_BSQL} select id, i60, round(exp(x), 4) as volume, round(exp(x - {_HALF['l']!r}), 4) as volume_min, round(exp(x + {_HALF['l']!r}), 4) as volume_max from (select id, i60, 6.07 + 0.71 * ln(i60) + 0.22 * {_LN.format('bt')} - 0.24 * ln(years) + 0.49 * ln(area) + 0.03 * sqrt(relief) as x from b, (values (16.0::double), (40.0)) t(i60))")
_SCORES = "select o_orderkey, (o_orderkey % 101) / 100 as p, o_totalprice as v from orders"


def _scored(s, d):
    return grids.table(s, d, "orders").select("o_orderkey", (F.pmod("o_orderkey", F.lit(101)) / 100).alias("p"), F.col("o_totalprice").alias("v"))


_PS = "(case when p <= 0.25 then 1 when p <= 0.5 then 2 when p <= 0.75 then 3 else 4 end)"
_VS = "(case when v <= 1000 then 1 when v <= 10000 then 2 when v <= 100000 then 3 else 4 end)"
_add("pscore", lambda s, d: _scored(s, d).select("o_orderkey", hazard.pscore("p").cast("int").alias("score")), f"select o_orderkey, {_PS}::int as score from ({_SCORES})")
_add("vscore", lambda s, d: _scored(s, d).select("o_orderkey", hazard.vscore("v").cast("int").alias("score")), f"select o_orderkey, {_VS}::int as score from ({_SCORES})")
_add("hscore", lambda s, d: _scored(s, d).select("o_orderkey", hazard.hscore(F.pmod("o_orderkey", F.lit(9))).cast("int").alias("score")), "select o_orderkey, (case when o_orderkey % 9 <= 3 then 1 when o_orderkey % 9 <= 6 then 2 else 3 end)::int as score from orders")
_add("hazard", lambda s, d: _scored(s, d).select("o_orderkey", hazard.hazard("p", "v").cast("int").alias("hazard")), f"select o_orderkey, (case when {_PS} + {_VS} <= 3 then 1 when {_PS} + {_VS} <= 6 then 2 else 3 end)::int as hazard from ({_SCORES})")


def _sweep(s, d):
    runs = s.range(40).select(F.col("id").cast("int").alias("run_idx"), (-3.0 - F.col("id") / 40).alias("b"), (0.1 + F.col("id") / 100).alias("ct"), (0.2 + F.col("id") / 200).alias("cf"), (0.3 + F.col("id") / 400).alias("cs"))
    return likelihood.sweep(_variables(s, d), [3.0], runs).groupBy("run_idx").agg(_r(F.avg("likelihood"), 4).alias("mean"), F.count("*").alias("n"))


_add("parameter_sweep", _sweep, f"with {_VARS} select run_idx, round(avg(exp(x) / (1 + exp(x))), 4) as mean, count(*) as n from (select k::int as run_idx, -3.0 - k / 40 + ((0.1 + k / 100) * t + (0.2 + k / 200) * f + (0.3 + k / 400) * s) * 3 as x from vars, range(0, 40) q(k)) group by 1")

# --- whole plans ---------------------------------------------------------------------------------
_add("geojson_segments", lambda s, d: features.segment_features(_network(s, d)))
_add("geojson_outlets", lambda s, d: features.outlet_features(_network(s, d)))
_add("geojson_basins", lambda s, d: features.basin_features(_network(s, d)))
_add("hazard_assessment", lambda s, d: assessment.run(s, d))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in _SQL.items()}
