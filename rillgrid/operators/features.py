"""Vector features: reading, checking, burning into rasters, and export as GeoJSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import projection as P
from ..errors import CoordinateError, FeatureError, GeometryError, PolygonError
from ..functions import nodata as N
from ..raster import Meta, Raster, grid_cells
from . import network as net

POINT_TYPES, POLYGON_TYPES = ("Point", "MultiPoint"), ("Polygon", "MultiPolygon")


def parse_geojson(text: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Features of GeoJSON strings, one collection or feature to a row, as ``(feature, part, properties, x, y | rings)``.

    ``properties`` is a map of strings. Multi-geometries come as one row for each part.
    """
    wanted = POINT_TYPES if kind == "point" else POLYGON_TYPES
    doc = F.parse_json(column)
    one = F.when(F.variant_get(doc, "$.type", "string") == "FeatureCollection", F.variant_get(doc, "$.features", "array<variant>")).otherwise(F.array(doc))
    rows = text.select(F.posexplode(one).alias("feature", "f"))
    rows = rows.select("feature", F.variant_get("f", "$.geometry.type", "string").alias("type"), F.variant_get("f", "$.geometry.coordinates", "variant").alias("c"), F.try_variant_get("f", "$.properties", "map<string,string>").alias("properties"))
    bad = rows.where(F.col("type").isNull() | ~F.col("type").isin(*wanted)).first()
    if bad is not None:
        raise GeometryError(f"feature {bad['feature']} has the geometry {bad['type']}, not one of {wanted}")
    depth = "array<double>" if kind == "point" else "array<array<array<double>>>"
    single = F.array(F.try_variant_get("c", "$", depth))
    parts = F.when(F.col("type") == wanted[0], single).otherwise(F.try_variant_get("c", "$", f"array<{depth}>"))
    rows = rows.select("feature", "properties", F.posexplode_outer(parts).alias("part", "c"))
    if kind == "point":
        return rows.select("feature", "part", "properties", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"), F.size("c").alias("n"))
    rings = F.transform("c", lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))
    return rows.select("feature", "part", "properties", rings.alias("rings"))


def check_points(points: DataFrame) -> DataFrame:
    """Points of two finite coordinates, or an error that names the first that isn't."""
    wrong = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    if "n" in points.columns:
        wrong = wrong | ~F.col("n").between(2, 3)
    bad = points.where(wrong).first()
    if bad is not None:
        raise CoordinateError(f"a point isn't two finite numbers: {bad.asDict()}")
    return points


def check_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons whose rings are closed and have four points or more, or an error."""
    finite = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))
    good = F.forall("rings", lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, finite))
    bad = polygons.where(F.col("rings").isNull() | (F.size("rings") == 0) | ~F.coalesce(good, F.lit(False))).first()
    if bad is not None:
        raise PolygonError("a polygon's ring is open, too short or not finite")
    return polygons


def point_bounds(points: DataFrame, crs=None) -> P.Bounds:
    e = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if e[0] is None:
        raise FeatureError("there are no features")
    return P.Bounds(*e, crs)


def polygon_bounds(polygons: DataFrame, crs=None) -> P.Bounds:
    """Edges of the outer rings."""
    edge = lambda f, k: f(F.transform(F.element_at("rings", 1), lambda p: p[k]))
    e = polygons.select(edge(F.array_min, "x").alias("a"), edge(F.array_min, "y").alias("b"), edge(F.array_max, "x").alias("c"), edge(F.array_max, "y").alias("d")).agg(F.min("a"), F.min("b"), F.max("c"), F.max("d")).first()
    if e[0] is None:
        raise FeatureError("there are no features")
    return P.Bounds(*e, crs)


def grid_of(bounds: P.Bounds, resolution: float | tuple[float, float], units: str = "base", pad: int = 0) -> tuple[tuple[int, int], P.Transform]:
    """Shape and transform of the grid of a resolution over bounds."""
    import math

    rx, ry = resolution if isinstance(resolution, tuple) else (resolution, resolution)
    y = bounds.center[1]
    rx, ry = P.units_to_base(bounds.crs, "x", rx, units, y), P.units_to_base(bounds.crs, "y", ry, units)
    box = bounds.orient(1)
    shape = math.ceil((box.top - box.bottom) / ry) + pad, math.ceil((box.right - box.left) / rx) + pad
    return shape, P.Transform(rx, -ry, box.left, box.top, bounds.crs)


def within(points: DataFrame, bounds: P.Bounds) -> DataFrame:
    """Points in bounds; the predicate reaches the scan."""
    b = bounds.orient(1)
    return points.where(F.col("x").between(b.left, b.right) & F.col("y").between(b.bottom, b.top))


def _burned(cells: DataFrame, spark, shape, transform, dtype: str, nodata) -> Raster:
    nodata = N.default(dtype) if nodata is None else nodata
    kind = N.SPARK_TYPES[dtype]
    rows = grid_cells(spark, *shape).join(cells.withColumn("__there", F.lit(True)), ["row", "col"], "left")
    value = F.when(F.col("__there"), F.col("value").cast(kind)).otherwise(F.lit(nodata).cast(kind))
    return Raster(rows.select("row", "col", value.alias("value")), Meta(*shape, dtype=dtype, nodata=nodata, transform=transform))


def _field(field: str | None, operation) -> Column:
    value = F.lit(True) if field is None else F.col(field)
    return operation(value) if operation is not None else value


def rasterize_points(points: DataFrame, field: str | None, shape: tuple[int, int], transform: P.Transform, *, order: str = "feature", dtype: str | None = None, nodata=None, operation=None) -> Raster:
    """Each point's value in its pixel, the last in order where several fall in one; True without a field.

    ``operation`` maps the field's column to another: any expression, or a vectorised function of the user's.
    """
    dtype = dtype or ("bool" if field is None else "float64")
    row, col = transform.rowcol("x", "y")
    rows = points.select(row.alias("row"), col.alias("col"), _field(field, operation).alias("v"), F.col(order).alias("o"))
    rows = rows.where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    cells = rows.groupBy("row", "col").agg(F.max_by("v", "o").alias("value"))
    return _burned(cells, points.sparkSession, shape, transform, dtype, nodata)


def rasterize_polygons(polygons: DataFrame, field: str | None, shape: tuple[int, int], transform: P.Transform, *, order: str = "feature", dtype: str | None = None, nodata=None, operation=None) -> Raster:
    """Each polygon's value in the pixels whose centres it holds, the last in order where several do.

    Every polygon meets every row of pixels it reaches, where the crossings of its edges with the centre line,
    sorted and taken in pairs, give runs of pixels: work is in proportion to edges and filled pixels, and holes come by the even-odd rule.
    """
    dtype = dtype or ("bool" if field is None else "float64")
    t = transform
    named = polygons.select(F.monotonically_increasing_id().alias("pid"), F.col(order).alias("o"), _field(field, operation).alias("v"), "rings")
    edges = named.select("pid", "o", "v", F.explode("rings").alias("ring"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda k: F.struct(F.element_at("ring", k).alias("a"), F.element_at("ring", k + 1).alias("b")))
    edges = edges.select("pid", "o", "v", F.explode(pairs).alias("e")).select("pid", "o", "v", F.col("e.a.x").alias("x1"), ((F.col("e.a.y") - t.top) / t.dy).alias("r1"), F.col("e.b.x").alias("x2"), ((F.col("e.b.y") - t.top) / t.dy).alias("r2"))
    low, high = F.least("r1", "r2"), F.greatest("r1", "r2")
    first, end = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5), F.lit(shape[0]))
    lines = edges.where(first < end).withColumn("row", F.explode(F.sequence(first, end - 1)))
    x = F.col("x1") + (F.col("row") + 0.5 - F.col("r1")) / (F.col("r2") - F.col("r1")) * (F.col("x2") - F.col("x1"))
    crossings = lines.select("pid", "o", "v", F.col("row").cast("int").alias("row"), ((x - t.left) / t.dx).alias("u"))
    spans = crossings.groupBy("pid", "o", "v", "row").agg(F.sort_array(F.collect_list("u")).alias("u"))
    runs = F.transform(F.sequence(F.lit(1), F.floor(F.size("u") / 2).cast("int")), lambda k: F.struct(F.element_at("u", 2 * k - 1).alias("a"), F.element_at("u", 2 * k).alias("b")))
    runs = spans.where(F.size("u") > 1).select("o", "v", "row", F.explode(runs).alias("s"))
    c0, c1 = F.greatest(F.ceil(F.col("s.a") - 0.5), F.lit(0)), F.least(F.ceil(F.col("s.b") - 0.5), F.lit(shape[1]))
    cells = runs.where(c0 < c1).select("o", "v", "row", F.explode(F.sequence(c0.cast("int"), c1.cast("int") - 1)).alias("col"))
    cells = cells.groupBy("row", "col").agg(F.max_by("v", "o").alias("value"))
    return _burned(cells, polygons.sparkSession, shape, transform, dtype, nodata)


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def _with_properties(table: DataFrame, properties: DataFrame | None) -> tuple[DataFrame, Column]:
    """Segments' properties ``(id, ..)`` joined; booleans as 0 and 1."""
    if properties is None:
        return table, F.struct(F.col("id"))
    names = [c for c in properties.columns if c != "id"]
    table = table.join(properties, "id", "left")
    cast = [F.col(c).cast("int").alias(c) if dict(properties.dtypes)[c] == "boolean" else F.col(c) for c in names]
    return table, F.struct("id", *cast)


def _moved(x: Column, y: Column, source, target) -> Column:
    if target is not None and not P.compatible(source, target):
        x, y = P.reproject(x, y, source, target)
    return F.array(x, y)


def segment_features(network: net.Network, properties: DataFrame | None = None, crs=None) -> DataFrame:
    """``(id, feature)``: a GeoJSON LineString for each segment."""
    table, props = _with_properties(net.coordinates(network), properties)
    line = F.transform("coords", lambda p: _moved(p["x"], p["y"], network.meta.crs, crs))
    return table.select("id", _feature(F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")), props).alias("feature"))


def outlet_features(network: net.Network, properties: DataFrame | None = None, crs=None, terminal: bool = True) -> DataFrame:
    """``(id, feature)``: a GeoJSON Point at the end of each terminal segment, or of each segment."""
    coords = net.coordinates(network)
    if terminal:
        coords = coords.join(network.segments.where("child is null").select("id"), "id", "left_semi")
    table, props = _with_properties(coords, properties)
    end = F.element_at("coords", -1)
    return table.select("id", _feature(F.struct(F.lit("Point").alias("type"), _moved(end["x"], end["y"], network.meta.crs, crs).alias("coordinates")), props).alias("feature"))


def basin_features(network: net.Network, properties: DataFrame | None = None, crs=None) -> DataFrame:
    """``(id, feature)``: a GeoJSON Polygon or MultiPolygon around each basin, holes included.

    The borders between cells of different basins are edges with the basin on their right. Tracing a basin's
    edges into rings is sequential, and done basin by basin.
    """
    import json

    cells = net.basins(network)
    own = cells.select("row", "col", F.col("basin").alias("id"))
    sides = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k).alias("side")) for k, (dr, dc) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1)))))
    asked = own.select("row", "col", "id", F.explode(sides).alias("s")).select((F.col("row") + F.col("s.dr")).alias("nr"), (F.col("col") + F.col("s.dc")).alias("nc"), "row", "col", "id", F.col("s.side").alias("side"))
    other = own.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("id").alias("other"))
    border = asked.join(other, ["nr", "nc"], "left").where("other is null or other <> id").select("id", "row", "col", "side")
    t, source, target = network.meta.grid, network.meta.crs, crs

    def trace(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        corner = {0: ((0, 0), (0, 1)), 1: ((0, 1), (1, 1)), 2: ((1, 1), (1, 0)), 3: ((1, 0), (0, 0))}
        ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, c, side in zip(pdf.row, pdf.col, pdf.side):
            (a, b), (d, e) = corner[side]
            ways.setdefault((r + a, c + b), []).append((r + d, c + e))
        rings = []
        for start in sorted(ways):
            while ways[start]:
                ring, at, before = [start], ways[start].pop(), start
                while at != start:
                    ring.append(at)
                    options = ways[at]
                    # where two cells touch by a corner the left turn joins them, so that a basin is connected over corners
                    turn = lambda n, at=at, before=before: (at[0] - before[0]) * (n[1] - at[1]) - (at[1] - before[1]) * (n[0] - at[0])
                    pick = max(options, key=turn)
                    options.remove(pick)
                    before, at = at, pick
                rings.append([*ring, start])
        area = lambda g: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(g, g[1:])) / 2
        outer, inner = [g for g in rings if area(g) > 0], [g for g in rings if area(g) < 0]
        polygons = [[g] for g in outer]

        def holds(g, p):
            y, x = p[0] + 0.5, p[1] + 0.5
            return sum((a[0] > y) != (b[0] > y) and x < a[1] for a, b in zip(g, g[1:])) % 2 == 1

        for hole in inner:
            low = min(hole)
            home = [p for p in polygons if holds(p[0], low)] or polygons[:1]
            min(home, key=lambda p: area(p[0])).append(hole)

        def place(p):
            x, y = t.left + p[1] * t.dx, t.top + p[0] * t.dy
            return list(P.reproject_point(x, y, source, target)) if target is not None else [x, y]

        shapes = [[[place(p) for p in g] for g in polygon] for polygon in polygons]
        geometry = {"type": "Polygon", "coordinates": shapes[0]} if len(shapes) == 1 else {"type": "MultiPolygon", "coordinates": shapes}
        return pd.DataFrame({"id": [key[0]], "geometry": [json.dumps(geometry)]})

    traced = border.groupBy("id").applyInPandas(trace, "id bigint, geometry string")
    table, props = _with_properties(traced, properties)
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.col("geometry"), F.lit(',"properties":'), F.to_json(props), F.lit("}"))
    return table.select("id", feature.alias("feature"))


FEATURES = {"segments": segment_features, "basins": basin_features, "outlets": outlet_features, "segment outlets": lambda n, p=None, c=None: outlet_features(n, p, c, terminal=False)}


def collection(features: DataFrame, crs=None) -> str:
    """One GeoJSON FeatureCollection, on the driver, of a table of features of modest size."""
    named = f', "crs": {{"type": "name", "properties": {{"name": "urn:ogc:def:crs:EPSG::{crs}"}}}}' if crs else ""
    return '{"type": "FeatureCollection"' + named + ', "features": [' + ", ".join(r["feature"] for r in features.orderBy("id").collect()) + "]}"


def save(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """Features as newline-delimited GeoJSON, written in parallel."""
    features.orderBy("id").select("feature").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def ordered(network: net.Network, table: DataFrame) -> DataFrame:
    """A table with ``id`` in the numbering of ``network.reference_order``."""
    return table.join(net.reference_order(network), "id").withColumn("id", F.col("number")).drop("number")

