import struct
import zlib

import numpy as np
import pytest

from rillgrid import projection as P
from rillgrid.errors import CRSError
from rillgrid.operators import spatial
from rillgrid.projection import Bounds, Transform
from rillgrid.raster import Raster
from rillgrid.sources import geotiff


def tiff(values, *, order="<", tile=None, strip=3, compression=1, predictor=1, nodata=None, crs=32611, point=False):
    """A file of the given layout, byte by byte."""
    values = values if values.ndim == 3 else values[:, :, None]
    nrows, ncols, samples = values.shape
    kind = values.dtype.newbyteorder(order)
    blocks, size = [], np.dtype(kind).itemsize
    height, width = tile or (strip, ncols)
    for r in range(0, nrows, height):
        for c in range(0, ncols, width):
            part = values[r : r + height, c : c + width]
            if tile:
                part = np.pad(part, ((0, height - part.shape[0]), (0, width - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)
            raw = part.astype(kind).tobytes()
            if predictor == 3:
                rows = part.astype(f">{values.dtype.kind}{size}").view(np.uint8).reshape(part.shape[0], -1, size)
                planes = np.moveaxis(rows, 2, 1).reshape(part.shape[0], -1).astype(np.int16)
                raw = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if compression == 8 else packed(raw) if compression == 5 else raw)
    codes = {"u": 1, "i": 2, "f": 3}
    entries = [(256, "I", [ncols]), (257, "I", [nrows]), (258, "H", [size * 8] * samples), (259, "H", [compression]), (262, "H", [1]), (277, "H", [samples]), (317, "H", [predictor]), (339, "H", [codes[values.dtype.kind]] * samples)]
    entries += [(322, "I", [width]), (323, "I", [height])] if tile else [(278, "I", [strip])]
    entries += [(33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), (34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 2 if point else 1, 3072, 0, 1, crs])]
    if nodata is not None:
        entries.append((42113, "s", nodata.encode() + b"\0"))
    n = len(entries) + 2
    at = 8 + 2 + 12 * n + 4
    extra = sum(len(v) * struct.calcsize(c) if c != "s" else len(v) for _, c, v in entries) + 8 * len(blocks) + 64
    offsets = [at + extra + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    entries += [(324 if tile else 273, "I", offsets), (325 if tile else 279, "I", [len(b) for b in blocks])]
    head, data = b"", b""
    for tag, code, v in sorted(entries):
        raw = v if code == "s" else struct.pack(f"{order}{len(v)}{code}", *v)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", at + len(data))
        data += b"" if len(raw) <= 4 else raw
        head += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], len(v)) + place
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(f"{order}HIH", 42, 8, n) + head + struct.pack(f"{order}I", 0) + data.ljust(extra, b"\0") + b"".join(blocks)


def packed(raw):
    """Codes of the Lempel-Ziv-Welch kind, with a code for every string that the table holds."""
    table = {bytes([k]): k for k in range(256)}
    codes, width, text, size = [(256, 9)], 9, b"", 258
    for byte in raw:
        if text + bytes([byte]) in table:
            text += bytes([byte])
            continue
        codes.append((table[text], width))
        table[text + bytes([byte])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size > 4093:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        text = bytes([byte])
    if text:
        codes.append((table[text], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits = "".join(format(c, f"0{w}b") for c, w in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


CASES = [
    ("int16", {}),
    ("uint8", {"order": ">", "strip": 4}),
    ("float32", {"tile": (16, 16), "compression": 8}),
    ("int32", {"tile": (16, 32), "compression": 8, "predictor": 2}),
    ("float64", {"order": ">", "tile": (16, 16), "compression": 8, "predictor": 3}),
    ("float32", {"strip": 7, "compression": 8, "predictor": 3}),
    ("uint16", {"strip": 40, "compression": 5, "predictor": 2, "order": ">"}),
]


@pytest.mark.parametrize("dtype, how", CASES)
def test_layouts(spark, tmp_path, dtype, how):
    values = np.random.default_rng(1).integers(0, 200, (41, 37)).astype(dtype)
    values[0, 0] = 7
    (tmp_path / "a.tif").write_bytes(tiff(values, nodata="7", **how))
    got = geotiff.read(spark, f"{tmp_path}/a.tif")
    assert (got.to_array() == values).all()
    assert got.meta.dtype == dtype and got.meta.nodata == 7 and got.meta.crs == 32611
    assert (got.meta.transform.left, got.meta.transform.top, got.meta.transform.dx, got.meta.transform.dy) == (500, 900, 10, -10)
    assert geotiff._lzw(packed(bytes(range(256)) * 40)) == bytes(range(256)) * 40


def test_bands_windows_and_pixels_that_are_points(spark, tmp_path):
    values = np.random.default_rng(2).integers(0, 99, (70, 50, 3)).astype("int16")
    (tmp_path / "b.tif").write_bytes(tiff(values, tile=(16, 16), point=True, crs=5070))
    got = geotiff.read(spark, f"{tmp_path}/b.tif", band=2, bounds=Bounds(600, 500, 700, 800, 5070))
    whole = geotiff.read(spark, f"{tmp_path}/b.tif", band=2)
    assert (whole.to_array() == values[:, :, 1]).all() and whole.meta.transform.left == 495 and whole.meta.crs == 5070
    want = spatial.windowed(whole, Bounds(600, 500, 700, 800, 5070))
    assert got.meta == want.meta and (got.to_array() == want.to_array()).all() and got.meta.size >= 300
    reader = geotiff._Reader(f"{tmp_path}/b.tif", 1, 2)
    reader.low, reader.high = {"row": 20, "col": 33}, {"row": 30}
    assert [p.numbers for p in reader.partitions()] == [[6, 7]]
    (tmp_path / "bad.tif").write_bytes(b"II*")
    with pytest.raises(Exception, match="TIFF|buffer|requires"):
        geotiff.layout(f"{tmp_path}/bad.tif")


@pytest.mark.parametrize("dtype, nodata", [("int16", -5), ("float32", float("nan")), ("bool", False), ("uint8", None), ("float64", -9999.5)])
def test_written_files_come_back(spark, tmp_path, dtype, nodata):
    values = (np.random.default_rng(3).integers(0, 2 if dtype == "bool" else 90, (150, 40))).astype(dtype)
    if dtype.startswith("float"):
        values[3, 3] = nodata
    given = Raster.from_array(spark, values, nodata=nodata, transform=Transform(2, -3, 10, 20, 4326))
    geotiff.write(given, f"{tmp_path}/out", rows_per_file=64)
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.endswith(".tif")]) == 3
    got = geotiff.read(spark, f"{tmp_path}/out", isbool=dtype == "bool")
    assert np.array_equal(got.to_array(), values, equal_nan=dtype.startswith("float"))
    assert got.meta.shape == (150, 40) and got.meta.transform == given.meta.transform
    with pytest.raises(FileExistsError):
        geotiff.write(given, f"{tmp_path}/out")
    geotiff.write(given, f"{tmp_path}/out", overwrite=True)


def test_systems(spark):
    for x, y in ((-96.0, 23.0), (-117.25, 34.5), (-80.0, 48.0)):
        for code in (5070, 3857, 26911, 4269):
            assert P.reproject_point(*P.reproject_point(x, y, 4269, code), code, 4326) == (pytest.approx(x, abs=1e-8), pytest.approx(y, abs=1e-8))
    assert P.reproject_point(-96.0, 23.0, 4269, 5070) == (pytest.approx(0, abs=1e-6), pytest.approx(0, abs=1e-6))
    assert P.reproject_point(180.0, 0.0, 4326, 3857) == (pytest.approx(np.pi * 6378137), pytest.approx(0, abs=1e-6))
    # equal areas: a small box covers the same area wherever it is, for its area on the ellipsoid
    for lon, lat in ((-120.0, 30.0), (-80.0, 47.0)):
        d = 0.001
        corners = [P.reproject_point(lon + a, lat + b, 4269, 5070) for a, b in ((0, 0), (d, 0), (d, d), (0, d))]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1]))) / 2
        e2, phi = 0.00669437999014, np.radians(lat + d / 2)
        want = np.radians(d) ** 2 * np.cos(phi) * 6378137**2 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 2
        assert area == pytest.approx(want, rel=1e-6)
    assert P.geographic(4269) and not P.geographic(5070) and P.name(5070).startswith("NAD83")
    with pytest.raises(CRSError):
        P.check(2154)
