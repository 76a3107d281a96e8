"""GeoTIFF: cells read block by block, in parallel, and rasters written as one file per block of rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition, LessThan

from ..errors import CRSError
from ..functions import nodata as N
from ..projection import Bounds, Transform, check
from ..raster import Meta, Raster
from . import rasters

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 17: 8}
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
BLOCKS_PER_PARTITION = 16


@dataclass
class Layout:
    """Where a file's blocks are, and how they are packed."""

    meta: Meta
    order: str
    width: int
    height: int
    offsets: tuple[int, ...]
    lengths: tuple[int, ...]
    compression: int
    predictor: int
    samples: int
    planar: bool
    kind: str
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.meta.ncols // self.width)

    @property
    def down(self) -> int:
        return -(-self.meta.nrows // self.height)


def _tags(file) -> tuple[str, dict[int, tuple]]:
    """Byte order and all tags of the first image, of classic and of big files."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count = struct.unpack(f"{order}Q", file.read_at(8, at))[0] if big else struct.unpack(f"{order}H", file.read_at(2, at))[0]
    size, first, room = (20, 8, 8) if big else (12, 2, 4)
    raw = file.read_at(count * size, at + first)
    found = {}
    for k in range(count):
        entry = raw[k * size : (k + 1) * size]
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        n = struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 : 4 + room])[0]
        if kind not in _CODES:
            continue
        total = n * _SIZES[kind]
        data = entry[4 + room :][:total] if total <= room else file.read_at(total, struct.unpack(f"{order}{'Q' if big else 'I'}", entry[4 + room :])[0])
        found[tag] = (data.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{n}{_CODES[kind]}", data)
    return order, found


def layout(path: str, crs: int | None = None) -> Layout:
    """Metadata and layout of a file, without its cells. A system that isn't supported is unknown, unless ``crs`` is given."""
    fs, place = pyarrow.fs.FileSystem.from_uri(rasters._uri(path))
    with fs.open_input_file(place) as file:
        order, tags = _tags(file)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    ncols, nrows, samples = one(256, 0), one(257, 0), one(277, 1)
    dtype = f"{_KINDS.get(one(339, 1), 'u')}{max(1, one(258, 1) // 8)}"
    if one(258, 1) % 8 or len(set(tags.get(258, (8,)))) > 1:
        raise ValueError(f"{path} has samples that are no whole bytes, or of several sizes")
    keys = tags.get(34735, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    if crs is None:
        try:
            crs = check(geo.get(3072, geo.get(2048)))
        except CRSError:
            crs = None
    transform = None
    if 33550 in tags and 33922 in tags:
        dx, dy = tags[33550][:2]
        i, j, _, x, y = tags[33922][:5]
        half = 0.5 if geo.get(1025) == 2 else 0.0
        transform = Transform(dx, -dy, x - (i + half) * dx, y + (j + half) * dy, crs)
    elif 34264 in tags:
        m = tags[34264]
        transform = Transform(m[0], m[5], m[3], m[7], crs)
    name = np.dtype(dtype).name
    text = one(42113, "").strip()
    nodata = None if not text else float(text) if name.startswith("f") or not text.lstrip("-").isdigit() else int(text)
    if nodata is not None and not name.startswith("f") and not np.iinfo(name).min <= nodata <= np.iinfo(name).max:
        nodata = None
    tiled = 322 in tags
    return Layout(
        Meta(nrows, ncols, name, nodata, transform, crs), order, one(322, ncols) if tiled else ncols, one(323, nrows) if tiled else min(nrows, one(278, nrows)),
        tags[324 if tiled else 273], tags[325 if tiled else 279], one(259, 1), one(317, 1), samples, one(284, 1) == 2, dtype, tiled,
    )


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first, with the early change of width that TIFF has."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, width, held, bits, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpack(raw: bytes, how: Layout, rows: int, band: int) -> np.ndarray:
    """One block's values of a band."""
    if how.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif how.compression == 5:
        raw = _lzw(raw)
    elif how.compression == 50000:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    elif how.compression != 1:
        raise ValueError(f"compression {how.compression} is not read")
    samples = 1 if how.planar else how.samples
    size = np.dtype(how.kind).itemsize
    values = np.frombuffer(raw, np.uint8)[: rows * how.width * samples * size]
    if how.predictor == 3:
        values = values.reshape(rows, -1, samples) if samples > 1 else values.reshape(rows, -1, 1)
        flat = np.cumsum(values, axis=1, dtype=np.uint8).reshape(rows, size, how.width * samples)
        values = np.ascontiguousarray(np.moveaxis(flat, 1, 2)).view(f">{how.kind}").reshape(rows, how.width, samples)
    else:
        values = values.view(f"{how.order}{how.kind}").reshape(rows, how.width, samples)
        if how.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=np.dtype(how.kind))
    return values[:, :, 0 if how.planar else band - 1].astype(how.kind)


class _Blocks(InputPartition):
    def __init__(self, path: str, numbers: list[int]):
        self.path, self.numbers = path, numbers


class _Reader(DataSourceReader):
    """Blocks that the filters on row and col leave, some to a partition."""

    def __init__(self, path: str, band: int, per_partition: int):
        self.path, self.band, self.step = path, band, per_partition
        self.low, self.high = {"row": 0, "col": 0}, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", ()) and f.attribute[0] in ("row", "col") else None
            if name and f.__class__ is GreaterThanOrEqual:
                self.low[name] = max(self.low[name], int(f.value))
            elif name and f.__class__ is LessThan:
                self.high[name] = min(self.high.get(name, int(f.value)), int(f.value))
            yield f  # blocks are skipped here, cells are filtered by Spark

    def partitions(self):
        how = layout(self.path)
        inside = lambda at, size, name, n: at * size < self.high.get(name, n) and (at + 1) * size > self.low[name]
        wanted = [r * how.across + c for r in range(how.down) if inside(r, how.height, "row", how.meta.nrows) for c in range(how.across) if inside(c, how.width, "col", how.meta.ncols)]
        return [_Blocks(self.path, wanted[k : k + self.step]) for k in range(0, len(wanted), self.step)] or [_Blocks(self.path, [])]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        how = layout(partition.path)
        fs, place = pyarrow.fs.FileSystem.from_uri(rasters._uri(partition.path))
        with fs.open_input_file(place) as file:
            for number in partition.numbers:
                top, left = number // how.across * how.height, number % how.across * how.width
                rows, cols = min(how.height, how.meta.nrows - top), min(how.width, how.meta.ncols - left)
                place_ = number + (self.band - 1) * how.across * how.down * how.planar
                stored = how.height if how.tiled else rows  # tiles are stored whole, beyond the raster's edges too
                raw = file.read_at(how.lengths[place_], how.offsets[place_])
                if not raw:  # a block left out holds NoData
                    values = np.full((rows, cols), how.meta.nodata or 0)
                else:
                    values = _unpack(raw, how, stored, self.band)[:rows, :cols]
                r, c = np.indices((rows, cols), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array((r + np.int32(top)).ravel()), pa.array((c + np.int32(left)).ravel()), pa.array(values.astype(np.float64).ravel())], names=["row", "col", "value"])


class GeoTiffSource(DataSource):
    """``spark.read.format("geotiff").load(path)``: cells of a GeoTIFF on a shared file system; options ``band`` and ``blocks_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("band", 1)), int(self.options.get("blocks_per_partition", BLOCKS_PER_PARTITION)))


def _stacked(parts: list[Raster]) -> Raster:
    """Blocks of rows, as ``write`` makes them, one below the other; they need no NoData, for they leave no gap."""
    first, top, cells = parts[0].meta, 0, None
    for part in parts:
        if part.meta.ncols != first.ncols or part.meta.grid.shifted(-top, 0) != first.grid:
            raise ValueError("files without NoData must be blocks of rows of one raster")
        rows = part.cells.select((F.col("row") + top).alias("row"), "col", "value")
        cells, top = rows if cells is None else cells.unionByName(rows), top + part.meta.nrows
    return Raster(cells, first.update(nrows=top))


def read(spark: SparkSession, path: str, *, band: int = 1, crs: int | None = None, bounds: Bounds | None = None, isbool: bool = False) -> Raster:
    """A raster from a GeoTIFF, or from a folder of them that lie on one grid; with ``bounds``, only the blocks of its window are read."""
    from ..operators.spatial import mosaic, windowed

    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fs, place = pyarrow.fs.FileSystem.from_uri(rasters._uri(path))
    if fs.get_file_info(place).type == pyarrow.fs.FileType.Directory:
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(place)) if f.path.lower().endswith((".tif", ".tiff")))
        parts = [read(spark, f, band=band, crs=crs) for f in files]
        if bounds is not None:
            parts = [p for p in parts if p.meta.bounds.overlaps(bounds if p.meta.crs in (None, bounds.crs) else bounds.reproject(p.meta.crs))]
        raster = parts[0] if len(parts) == 1 else _stacked(parts) if parts[0].meta.nodata is None else mosaic(parts)
    else:
        meta = layout(path, crs).meta
        kind = {"int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "float32": "float"}.get(meta.dtype, "bigint" if "int" in meta.dtype else "double")
        cells = spark.read.format("geotiff").option("band", band).load(path)
        raster = Raster(cells.select("row", "col", F.col("value").cast(kind).alias("value")), meta)
    raster = windowed(raster, bounds) if bounds is not None else raster
    return raster.as_bool() if isbool else raster


def encode(values: np.ndarray, meta: Meta) -> bytes:
    """One GeoTIFF, deflated in one strip per 64 rows."""
    dtype = np.dtype("uint8" if meta.dtype == "bool" else meta.dtype)
    values = np.ascontiguousarray(values.astype(dtype.newbyteorder("<")))
    step = 64
    strips = [zlib.compress(values[k : k + step].tobytes()) for k in range(0, len(values), step)]
    short, long, double = (lambda *v, kind=kind: (kind, len(v), struct.pack(f"<{len(v)}{_CODES[kind]}", *v)) for kind in (3, 4, 12))
    tags = {256: long(values.shape[1]), 257: long(values.shape[0]), 258: short(dtype.itemsize * 8), 259: short(8), 262: short(1), 277: short(1), 278: long(step), 279: long(*map(len, strips)), 317: short(1), 339: short({"u": 1, "i": 2, "f": 3}[dtype.kind])}
    if meta.transform is not None:
        t = meta.transform
        if t.dx > 0 > t.dy:
            tags |= {33550: double(t.dx, -t.dy, 0.0), 33922: double(0.0, 0.0, 0.0, t.left, t.top, 0.0)}
        else:
            tags[34264] = double(t.dx, 0.0, 0.0, t.left, 0.0, t.dy, 0.0, t.top, *(0.0,) * 7, 1.0)
        if meta.crs is not None:
            flat = meta.crs in (4326, 4269)
            tags[34735] = short(1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, meta.crs)
    if meta.nodata is not None and meta.dtype != "bool":
        text = ("nan" if N.is_nan(meta.nodata) else repr(meta.nodata.item() if hasattr(meta.nodata, "item") else meta.nodata)).encode() + b"\0"
        tags[42113] = (2, len(text), text)
    tags[273] = long(*([0] * len(strips)))
    extra = 8 + 2 + 12 * len(tags) + 4
    starts = extra + sum(len(d) + len(d) % 2 for _, _, d in tags.values() if len(d) > 4)
    tags[273] = long(*(starts + sum(map(len, strips[:k])) for k in range(len(strips))))
    directory, data = [], b""
    for tag in sorted(tags):
        kind, n, raw = tags[tag]
        if len(raw) <= 4:
            directory.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        else:
            directory.append(struct.pack("<HHII", tag, kind, n, extra + len(data)))
            data += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(directory) + struct.pack("<I", 0) + data + b"".join(strips)


def write(raster: Raster, path: str, rows_per_file: int = 1024, overwrite: bool = False) -> None:
    """Writes a folder of GeoTIFFs, one per block of rows, each by the task that holds it; ``read`` takes the folder as one raster."""
    meta = raster.meta
    fs, place = pyarrow.fs.FileSystem.from_uri(rasters._uri(path))
    if fs.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
        if not overwrite:
            raise FileExistsError(path)
        fs.delete_dir(place)
    fs.create_dir(place, recursive=True)
    uri = rasters._uri(path).rstrip("/")

    def save(cells: pa.Table) -> pa.Table:
        block = cells["block"][0].as_py()
        top = block * rows_per_file
        own = meta.update(nrows=min(rows_per_file, meta.nrows - top), transform=None if meta.transform is None else meta.transform.shifted(top, 0))
        values = np.full(own.shape, 0 if meta.nodata is None else meta.nodata, "bool" if meta.dtype == "bool" else meta.dtype)
        values[cells["row"].to_numpy() - top, cells["col"].to_numpy()] = cells["value"].to_numpy()
        own_fs, folder = pyarrow.fs.FileSystem.from_uri(uri)
        name = f"{folder}/part-{block:06d}.tif"
        # a task may run twice: each run writes a file of its own, and the last one moves it into place
        draft = f"{folder}/.{block:06d}-{id(values)}"
        with own_fs.open_output_stream(draft) as out:
            out.write(encode(values, own))
        own_fs.move(draft, name)
        return pa.table({"file": [name]})

    blocks = raster.cells.select("row", "col", "value", F.floor(F.col("row") / rows_per_file).cast("int").alias("block"))
    blocks.groupBy("block").applyInArrow(save, "file string").write.format("noop").mode("overwrite").save()
