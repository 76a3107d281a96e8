"""Names and file extensions of raster and vector formats, and titles as slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RASTER = "ADRG .gen|BMP .bmp|BT .bt|BYN .byn .err|EHdr .bil|ERS .ers|GTiff .tif .tiff|HFA .img|ILWIS .mpr .mpl|ISIS3 .lbl .cub|KRO .kro|MFF .hdr|NITF .ntf|NTv2 .gsb .gvb|NWT_GRD .grd|PCIDSK .pix|PCRaster .map|PDS4 .xml|RMF .rsw|SAGA .sdat .sg-grd-z|SGI .rgb|Terragen .ter|USGSDEM .dem|VRT .vrt"
_VECTOR = "CSV .csv|DGN .dgn|DXF .dxf|FlatGeobuf .fgb|GML .gml .xml|GPKG .gpkg|GPX .gpx|GeoJSON .json .geojson|GeoJSONSeq .geojsons .geojsonl|MapInfo File .tab .mid .mif|OGR_GMT .gmt|OpenFileGDB .gdb|Shapefile .shp .dbf .shz .shp.zip|SQLite .sqlite .db"
TABLES: dict[str, dict[str, list[str]]] = {kind: {e.split(" ")[0].replace(" ", " "): e.split(" ")[1:] for e in text.split("|")} for kind, text in (("raster", _RASTER), ("vector", _VECTOR))}


def table(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """``(kind, driver, extensions)``."""
    rows = [(k, name, found) for k, t in TABLES.items() if kind in (None, k) for name, found in t.items()]
    return spark.createDataFrame(rows, "kind string, driver string, extensions array<string>")


def rasters(spark: SparkSession) -> DataFrame:
    return table(spark, "raster")


def vectors(spark: SparkSession) -> DataFrame:
    return table(spark, "vector")


def info(spark: SparkSession, driver: str) -> DataFrame:
    """The row of one driver."""
    if not any(driver in t for t in TABLES.values()):
        raise ValueError(f"no driver {driver}")
    return table(spark).where(F.col("driver") == driver)


def extensions(spark: SparkSession, kind: str) -> DataFrame:
    """``(extension, driver)`` in order."""
    rows = table(spark, kind).select(F.explode("extensions").alias("extension"), "driver")
    return rows.orderBy("extension", "driver")


def from_extension(extension: str, kind: str) -> str | None:
    """The driver of an extension, with or without its dot and in any case; None if there is none."""
    wanted = "." + extension.lower().lstrip(".")
    found = [name for name, own in TABLES[kind].items() if wanted in own]
    if wanted == ".xml":
        raise ValueError("the extension .xml has no one driver; name it")
    return found[0] if found else None


def from_path(path: str, kind: str) -> str | None:
    """The driver of a path's suffix; .shp.zip counts as one."""
    name = str(path).replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name.endswith(".shp.zip"):
        return from_extension(".shp.zip", kind)
    return from_extension(name.rsplit(".", 1)[1], kind) if "." in name else None


def driver_of(path: Column, kind: str) -> Column:
    """The same as an expression over a column of paths; null if there is none."""
    suffix = F.lower(F.regexp_extract(path, r"(?i)(\.shp\.zip|\.[^./]+)$", 1))
    pairs = [x for name, own in TABLES[kind].items() for e in own if e != ".xml" for x in (F.lit(e), F.lit(name))]
    return F.element_at(F.create_map(*pairs), suffix)


def slug(title: Column) -> Column:
    """A title as a slug: lower case, words joined by hyphens, other signs dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9\s-]", "")), r"[\s-]+", "-")


def slugify(title: str) -> str:
    """``slug`` of one string."""
    return re.sub(r"[\s-]+", "-", re.sub(r"[^a-z0-9\s-]", "", title.lower()).strip())
