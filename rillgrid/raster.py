"""Rasters as relations: a DataFrame of cells and the metadata of their grid."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection as P
from .errors import CRSError, EmptyError, MissingTransformError, OverlapError, ShapeError, TransformError
from .functions import nodata as N
from .functions.expr import number


@dataclass(frozen=True)
class Meta:
    """Shape, type, NoData, transform and name of a raster."""

    nrows: int
    ncols: int
    dtype: str = "float64"
    nodata: object = None
    transform: P.Transform | None = None
    crs: int | None = None
    name: str = "raster"

    def __post_init__(self):
        if self.nrows < 0 or self.ncols < 0:
            raise ShapeError("a shape has no negative size")
        np.dtype(self.dtype)
        crs = P.check(self.crs)
        if self.transform is not None:
            if crs is not None and self.transform.crs is not None and crs != self.transform.crs:
                raise CRSError("the transform has another coordinate reference system")
            crs = crs if self.transform.crs is None else self.transform.crs
            object.__setattr__(self, "transform", replace(self.transform, crs=crs))
        object.__setattr__(self, "crs", crs)
        if self.nodata is not None:
            object.__setattr__(self, "nodata", N.cast(self.nodata, self.dtype, "unsafe"))

    @classmethod
    def from_bounds(cls, nrows: int, ncols: int, bounds: P.Bounds, **more) -> Meta:
        """With the transform that lays the shape over the bounds."""
        if not nrows or not ncols:
            raise EmptyError("an empty raster can't be laid over bounds")
        return cls(nrows, ncols, transform=bounds.transform(nrows, ncols), **more)

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    @property
    def size(self) -> int:
        return self.nrows * self.ncols

    @property
    def nbytes(self) -> int:
        return self.size * np.dtype(self.dtype).itemsize

    @property
    def grid(self) -> P.Transform:
        """The transform, which must be there."""
        if self.transform is None:
            raise MissingTransformError(f"{self.name} has no transform")
        return self.transform

    @property
    def bounds(self) -> P.Bounds:
        return self.grid.bounds(self.nrows, self.ncols)

    def _middle(self) -> float:
        return self.bounds.center[1]

    def resolution(self, units: str = "meters") -> tuple[float, float]:
        return self.grid.resolution(units, self._middle())

    def pixel_area(self, units: str = "meters") -> float:
        return self.grid.pixel_area(units, self._middle())

    def pixel_diagonal(self, units: str = "meters") -> float:
        return self.grid.pixel_diagonal(units, self._middle())

    def utm_zone(self) -> int | None:
        return self.bounds.utm_zone()

    def update(self, **changes) -> Meta:
        return replace(self, **changes)

    def as_bool(self) -> Meta:
        return self.update(dtype="bool", nodata=False)

    def ensure_nodata(self, default=None, casting: str = "safe") -> Meta:
        """With a NoData value, the type's own unless one is given."""
        if self.nodata is not None:
            return self
        return self.update(nodata=N.default(self.dtype) if default is None else N.cast(default, self.dtype, casting))

    def same(self, other: Meta) -> bool:
        """Equal, NaN being itself."""
        return self.update(nodata=None) == other.update(nodata=None) and N.equal(self.nodata, other.nodata)

    def isclose(self, other: Meta) -> bool:
        grids = self.transform is None and other.transform is None or self.transform is not None and other.transform is not None and self.transform.isclose(other.transform)
        return self.shape == other.shape and self.dtype == other.dtype and N.equal(self.nodata, other.nodata) and grids

    def sliced(self, rows: slice, cols: slice) -> Meta:
        """Metadata of a window of rows and columns."""
        (r0, r1, rs), (c0, c1, cs) = rows.indices(self.nrows), cols.indices(self.ncols)
        if rs != 1 or cs != 1:
            raise ValueError("a slice has steps of 1")
        if r1 <= r0 or c1 <= c0:
            raise EmptyError("the slice has no pixels")
        return self.update(nrows=r1 - r0, ncols=c1 - c0, transform=self.transform and self.transform.shifted(r0, c0))

    def limits(self, bounds: P.Bounds) -> tuple[int, int, int, int]:
        """First and end row, first and end column of bounds, rounded to pixels; they may lie outside."""
        if not P.compatible(self.crs, bounds.crs):
            bounds = bounds.reproject(self.crs)
        box, t = bounds.orient(self.grid.orientation), self.grid
        near = lambda v: int(math.floor(v + 0.5))
        return near((box.top - t.top) / t.dy), near((box.bottom - t.top) / t.dy), near((box.left - t.left) / t.dx), near((box.right - t.left) / t.dx)

    def window(self, bounds: P.Bounds) -> Meta:
        """Metadata of the part within bounds, on this raster's own pixels."""
        r0, r1, c0, c1 = self.limits(bounds)
        r0, r1, c0, c1 = max(r0, 0), min(r1, self.nrows), max(c0, 0), min(c1, self.ncols)
        if r1 <= r0 or c1 <= c0:
            raise OverlapError("the bounds don't overlap the raster")
        return self.sliced(slice(r0, r1), slice(c0, c1))

    def buffers(self, distance: float, units: str, edges: dict[str, float]) -> dict[str, int]:
        """Whole pixels of a buffer along each edge, rounded up."""
        sizes = {e: edges.get(e, distance) or 0 for e in ("left", "bottom", "right", "top")}
        if any(d < 0 for d in sizes.values()) or not any(sizes.values()):
            raise ValueError("a buffer has a positive distance")
        if units == "pixels":
            return {e: math.ceil(d) for e, d in sizes.items()}
        y = self._middle()
        out = {}
        for e, d in sizes.items():
            axis = "x" if e in ("left", "right") else "y"
            base = P.units_to_base(self.crs, axis, d, units, y)
            out[e] = math.ceil(base / abs(self.grid.dx if axis == "x" else self.grid.dy) - 1e-12)
        return out

    def buffered(self, pixels: dict[str, int]) -> Meta:
        moved = self.transform and self.transform.shifted(-pixels["top"], -pixels["left"])
        return self.update(nrows=self.nrows + pixels["top"] + pixels["bottom"], ncols=self.ncols + pixels["left"] + pixels["right"], transform=moved)

    def todict(self) -> dict:
        return {"nrows": self.nrows, "ncols": self.ncols, "dtype": self.dtype, "nodata": self.nodata, "crs": self.crs, "transform": self.transform and self.transform.todict(), "name": self.name}


class Raster:
    """Cells ``(row, col, value)``, every cell once, and their metadata. Immutable and lazy.

    Cells are joined by merging, never broadcast: they come from arrays or compressed files, of which the planner knows neither the length nor the size in memory.
    """

    def __init__(self, cells: DataFrame, meta: Meta):
        self.cells, self.meta = cells.hint("merge"), meta

    @classmethod
    def from_array(cls, spark: SparkSession, array, *, isbool: bool = False, **meta) -> Raster:
        """A small array as a raster. Large rasters come from tables or files."""
        values = np.atleast_2d(np.asarray(array))
        values = values.reshape(-1, 1) if np.ndim(array) == 1 else values
        if values.ndim != 2 or not values.size:
            raise EmptyError("a raster is a matrix with elements")
        dtype = meta.pop("dtype", values.dtype.name)
        kind = N.SPARK_TYPES[np.dtype(dtype).name]
        rows = [(r, c, v) for r, line in enumerate(values.tolist()) for c, v in enumerate(line)]
        wide = "boolean" if kind == "boolean" else "double" if np.dtype(dtype).kind == "f" else "bigint"
        cells = spark.createDataFrame(rows, f"row int, col int, value {wide}").withColumn("value", F.col("value").cast(kind))
        raster = cls(cells, Meta(*values.shape, dtype=np.dtype(dtype).name, **meta))
        return raster.as_bool() if isbool else raster

    @classmethod
    def from_rows(cls, table: DataFrame, meta: Meta, row: str = "row", values: str = "values") -> Raster:
        """From the dense form: a row number and an array of its values."""
        cells = table.select(F.col(row).cast("int").alias("row"), F.posexplode(values).alias("col", "value"))
        return cls(cells, meta)

    @classmethod
    def from_cells(cls, table: DataFrame, **meta) -> Raster:
        """From any table of cells; the shape is read off it unless given."""
        if "nrows" not in meta:
            top = table.agg(F.max("row"), F.max("col")).first()
            if top[0] is None:
                raise EmptyError("the table has no cells")
            meta |= {"nrows": top[0] + 1, "ncols": top[1] + 1}
        return cls(table.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value"), Meta(**meta))

    def to_rows(self) -> DataFrame:
        """The dense form ``(row, values)``."""
        inside = F.sort_array(F.collect_list(F.struct("col", "value")))
        return self.cells.groupBy("row").agg(inside.alias("c")).select("row", F.transform("c", lambda x: x["value"]).alias("values"))

    def to_array(self) -> np.ndarray:
        """A numpy array on the driver, for small rasters."""
        pdf = self.cells.toPandas()
        out = np.full(self.meta.shape, np.nan if np.dtype(self.meta.dtype).kind == "f" else 0, dtype=self.meta.dtype)
        out[pdf.row.to_numpy(), pdf.col.to_numpy()] = pdf.value.to_numpy()
        return out

    def with_value(self, value: Column, **changes) -> Raster:
        return Raster(self.cells.select("row", "col", value.alias("value")), self.meta.update(**changes))

    def as_bool(self) -> Raster:
        """As a mask, NoData being false."""
        value = ~N.mask("value", self.meta.nodata) & (number("value") != 0)
        return self.with_value(value, dtype="bool", nodata=False)

    def ensure_nodata(self, default=None, casting: str = "safe") -> Raster:
        return Raster(self.cells, self.meta.ensure_nodata(default, casting))

    def override(self, **changes) -> Raster:
        """With other metadata and the same cells."""
        bounds = changes.pop("bounds", None)
        if bounds is not None:
            changes["transform"] = bounds.transform(*self.meta.shape)
        if "crs" in changes and "transform" not in changes and self.meta.transform is not None:
            changes["transform"] = replace(self.meta.transform, crs=P.check(changes["crs"]))
        return Raster(self.cells, self.meta.update(**changes))

    @property
    def nodata_mask(self) -> Raster:
        return self.with_value(N.mask("value", self.meta.nodata), dtype="bool", nodata=False)

    @property
    def data_mask(self) -> Raster:
        return self.with_value(N.data_mask("value", self.meta.nodata), dtype="bool", nodata=False)

    def as_nan(self, name: str = "value") -> DataFrame:
        """Cells as doubles with NoData as NaN."""
        return self.cells.select("row", "col", N.to_nan("value", self.meta.nodata).alias(name))

    def validate(self, other: Raster, name: str = "raster") -> Raster:
        """``other``, checked to lie on this grid; what it lacks of a location it takes from here."""
        if other.meta.shape != self.meta.shape:
            raise ShapeError(f"{name} has the shape {other.meta.shape}, not {self.meta.shape}")
        if not P.compatible(other.meta.crs, self.meta.crs):
            raise CRSError(f"{name} has another coordinate reference system")
        a, b = other.meta.transform, self.meta.transform
        if a is not None and b is not None and not a.isclose(b):
            raise TransformError(f"{name} has another transform")
        return other.override(transform=a or b, crs=other.meta.crs or self.meta.crs)

    def equals(self, other: Raster) -> bool:
        """Same metadata and same cells, NaN being itself."""
        if not self.meta.same(other.meta):
            return False
        return self.cells.exceptAll(other.cells).isEmpty() and other.cells.exceptAll(self.cells).isEmpty()

    def __repr__(self) -> str:
        return f"Raster({self.meta})"


def grid_cells(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """``(row, col)`` of every cell of a grid, made in parallel by row; not to be broadcast, as the planner counts rows only."""
    return spark.range(nrows).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))).alias("col")).hint("merge")
