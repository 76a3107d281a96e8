"""Raster files and tables.

Cells are stored as Parquet beside a small JSON file of metadata, laid out by blocks of rows so that windows skip
what they don't need. ESRI ASCII grids and NumPy files are read by a Python data source in parallel blocks of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThan

from ..functions import nodata as N
from ..projection import Bounds, Transform
from ..raster import Meta, Raster

BLOCK_ROWS = 256


def _meta_path(path: str) -> str:
    return f"{path.rstrip('/')}/_meta.json"


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def save(raster: Raster, path: str, overwrite: bool = False) -> None:
    """Writes cells and metadata; masks as bytes of 0 and 1."""
    meta = raster.meta
    cells = raster.cells
    if meta.dtype == "bool":
        cells, meta = cells.withColumn("value", F.col("value").cast("tinyint")), meta.update(dtype="int8", nodata=None)
    blocks = cells.withColumn("block", (F.col("row") / BLOCK_ROWS).cast("int"))
    blocks.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    fs, place = pyarrow.fs.FileSystem.from_uri(_uri(_meta_path(path)))
    values = meta.todict()
    if N.is_nan(values["nodata"]):
        values["nodata"] = "nan"
    with fs.open_output_stream(place) as out:
        out.write(json.dumps(values).encode())


def load_meta(path: str) -> Meta:
    """Metadata alone, without reading cells."""
    fs, place = pyarrow.fs.FileSystem.from_uri(_uri(_meta_path(path)))
    with fs.open_input_stream(place) as file:
        values = json.loads(file.read())
    if values["nodata"] == "nan":
        values["nodata"] = float("nan")
    if values["transform"]:
        values["transform"] = Transform(**values["transform"])
    return Meta(**values)


def load(spark: SparkSession, path: str, bounds: Bounds | None = None, isbool: bool = False) -> Raster:
    """A saved raster, or its window in bounds: the window's rows and columns are predicates of the scan."""
    from ..operators.spatial import windowed

    raster = Raster(spark.read.parquet(path).select("row", "col", "value"), load_meta(path))
    raster = windowed(raster, bounds) if bounds is not None else raster
    return raster.as_bool() if isbool else raster


def ascii_meta(path: str, crs: int | None = None) -> tuple[Meta, int]:
    """Metadata of an ESRI ASCII grid and the number of lines of its header."""
    fs, place = pyarrow.fs.FileSystem.from_uri(_uri(path))
    fields: dict[str, float] = {}
    lines = 0
    with fs.open_input_stream(place) as file:
        for line in file.read(4096).decode("ascii", "replace").splitlines():
            parts = line.split()
            if len(parts) != 2 or not parts[0][0].isalpha():
                break
            fields[parts[0].lower()] = float(parts[1])
            lines += 1
    missing = [k for k in ("ncols", "nrows", "cellsize") if k not in fields]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)} in its header")
    size, nrows, ncols = fields["cellsize"], int(fields["nrows"]), int(fields["ncols"])
    half = size / 2 if "xllcenter" in fields else 0
    left, bottom = fields.get("xllcorner", fields.get("xllcenter", 0)) - half, fields.get("yllcorner", fields.get("yllcenter", 0)) - half
    return Meta(nrows, ncols, "float64", fields.get("nodata_value"), Transform(size, -size, left, bottom + nrows * size, crs)), lines


class _Block(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _GridReader(DataSourceReader):
    """Blocks of rows of a .npy file or an ESRI ASCII grid; filters on row skip blocks."""

    def __init__(self, path: str, rows_per_block: int):
        self.path, self.step = path, rows_per_block
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        for f in filters:
            if f.__class__ is GreaterThanOrEqual and f.attribute == ("row",):
                self.low = max(self.low, int(f.value))
            elif f.__class__ is LessThan and f.attribute == ("row",):
                self.high = int(f.value) if self.high is None else min(self.high, int(f.value))
            yield f  # blocks are skipped here, rows are filtered by Spark

    def _shape(self) -> tuple[int, int]:
        if self.path.endswith(".npy"):
            return np.load(self.path, mmap_mode="r").shape
        return ascii_meta(self.path)[0].shape

    def partitions(self):
        nrows = self._shape()[0]
        high = nrows if self.high is None else min(nrows, self.high)
        return [_Block(a, min(a + self.step, high)) for a in range(self.low, high, self.step)] or [_Block(0, 0)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if self.path.endswith(".npy"):
            values = np.asarray(np.load(self.path, mmap_mode="r")[partition.first : partition.end], np.float64)
        else:
            _, skip = ascii_meta(self.path)
            with open(self.path.removeprefix("file://")) as file:
                for _ in range(skip + partition.first):
                    next(file)
                values = np.array([[float(x) for x in next(file).split()] for _ in range(partition.end - partition.first)])
        if values.size:
            rows, cols = np.indices(values.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows.ravel() + np.int32(partition.first)), pa.array(cols.ravel()), pa.array(values.ravel())], names=["row", "col", "value"])


class GridSource(DataSource):
    """``spark.read.format("grid").load(path)``: cells of a .npy file or an ESRI ASCII grid on a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _GridReader(self.options["path"], int(self.options.get("rows_per_block", BLOCK_ROWS)))


def read_grid(spark: SparkSession, path: str, *, crs: int | None = None, bounds: Bounds | None = None, isbool: bool = False, **meta) -> Raster:
    """A raster from a .npy file or an ESRI ASCII grid, or its window in bounds."""
    from ..operators.spatial import windowed

    spark.dataSource.register(GridSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cells = spark.read.format("grid").load(path)
    if path.endswith(".npy"):
        nrows, ncols = np.load(path, mmap_mode="r").shape
        found = Meta(nrows, ncols, "float64", **meta)
    else:
        found = ascii_meta(path, crs)[0].update(**meta)
    raster = Raster(cells, found)
    raster = windowed(raster, bounds) if bounds is not None else raster
    return raster.as_bool() if isbool else raster


def write_ascii(raster: Raster, path: str, overwrite: bool = False) -> None:
    """Writes an ESRI ASCII grid as a folder of text: the header and lines of cells in order."""
    meta, (width, height) = raster.meta, (abs(raster.meta.grid.dx), abs(raster.meta.grid.dy))
    if not math.isclose(width, height):
        raise ValueError("an ASCII grid has square pixels")
    b = meta.bounds.orient(1)
    head = [f"ncols {meta.ncols}", f"nrows {meta.nrows}", f"xllcorner {b.left!r}", f"yllcorner {b.bottom!r}", f"cellsize {width!r}"] + ([f"NODATA_value {meta.nodata}"] if meta.nodata is not None else [])
    spark = raster.cells.sparkSession
    lines = raster.to_rows().select(F.col("row").cast("bigint").alias("n"), F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("line"))
    header = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "n bigint, line string")
    header.unionByName(lines).orderBy("n").select("line").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Point or polygon features of GeoJSON files: whole files, or one feature to a line."""
    from ..operators.features import parse_geojson

    whole = not path.endswith((".geojsonl", ".geojsons", ".txt"))
    return parse_geojson(spark.read.text(path, wholetext=whole), kind)
