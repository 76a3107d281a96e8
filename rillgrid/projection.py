"""Coordinate systems, transforms and bounding boxes.

Supported systems are WGS 84 (EPSG:4326) and its UTM zones (EPSG:32601-32660, 32701-32760), NAD 83 (EPSG:4269), its zones
(EPSG:26901-26923) and its equal-area projection of the conterminous states (EPSG:5070), and Web Mercator (EPSG:3857). The
ellipsoids of NAD 83 and WGS 84 are the same to a tenth of a millimetre, and their coordinates are taken as the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import CRSError, MissingCRSError, TransformError
from .functions import units as U
from .functions.expr import col

RADIUS = 6_371_000.0
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _E2 = 0.9996, _F * (2 - _F)
_N = _F / (2 - _F)
_NAMES = {4326: "WGS 84", 4269: "NAD83", 5070: "NAD83 / Conus Albers", 3857: "WGS 84 / Pseudo-Mercator"}


def check(crs) -> int | None:
    """An EPSG code, from a number or a string such as 'EPSG:32611'; None stays None."""
    if crs is None:
        return None
    text = str(crs).strip().upper().removeprefix("EPSG:")
    code = int(text) if text.isdigit() else -1
    if code in _NAMES or zone(code):
        return code
    raise CRSError(f"{crs} is not supported: WGS 84, NAD 83, their UTM zones, EPSG:5070 and EPSG:3857 are")


def geographic(crs) -> bool:
    """Whether coordinates are degrees of longitude and latitude."""
    return check(crs) in (4326, 4269)


def zone(code: int | None) -> tuple[int, bool] | None:
    """UTM zone and whether it is northern; None for other systems."""
    for first, last, north in ((32601, 32660, True), (32701, 32760, False), (26901, 26923, True)):
        if code is not None and first <= code <= last:
            return code - first + 1, north
    return None


def name(crs) -> str:
    code = check(crs)
    if code is None:
        return "None"
    found = zone(code)
    return _NAMES[code] if not found else f"{'NAD83' if code < 30000 else 'WGS 84'} / UTM zone {found[0]}{'N' if found[1] else 'S'}"


def compatible(a, b) -> bool:
    """Equal, or at least one unknown."""
    return a is None or b is None or check(a) == check(b)


def axis_units(crs) -> tuple[str | None, str | None]:
    """Units of the x and y axes."""
    code = check(crs)
    return (None, None) if code is None else ("degree", "degree") if geographic(code) else ("metre", "metre")


def y_units_per_m(crs) -> float:
    """Axis units of y in a metre."""
    if check(crs) is None:
        raise MissingCRSError("units need a coordinate reference system")
    return math.degrees(1 / RADIUS) if geographic(crs) else 1.0


def x_units_per_m(crs, y: float | None = None) -> float:
    """Axis units of x in a metre; for degrees at latitude ``y``."""
    if not geographic(crs):
        return y_units_per_m(crs)
    return y_units_per_m(crs) / math.cos(math.radians(y or 0.0))


def units_per_m(crs, y: float | None = None) -> tuple[float, float]:
    return x_units_per_m(crs, y), y_units_per_m(crs)


def base_to_units(crs, axis: str, distance: float, units: str, y: float | None = None) -> float:
    """A length along an axis in other units; along x in degrees by the haversine at latitude ``y``."""
    units = U.standardize(units)
    if units == "base":
        return distance
    if check(crs) is None:
        raise MissingCRSError("units need a coordinate reference system")
    if not geographic(crs):
        meters = distance
    elif axis == "x":
        h = (math.cos(math.radians(y or 0.0)) * math.sin(math.radians(distance) / 2)) ** 2
        meters = 2 * RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    else:
        meters = math.radians(distance) * RADIUS
    return meters * U.factor("meters", units)


def units_to_base(crs, axis: str, distance: float, units: str, y: float | None = None) -> float:
    """The inverse of ``base_to_units``."""
    units = U.standardize(units)
    if units == "base":
        return distance
    if check(crs) is None:
        raise MissingCRSError("units need a coordinate reference system")
    meters = distance * U.factor(units, "meters")
    if not geographic(crs):
        return meters
    if axis == "y":
        return math.degrees(meters / RADIUS)
    lat, arc = math.radians(y or 0.0), meters / RADIUS
    return math.degrees(2 * math.asin(min(1.0, math.sin(arc / 2) / math.cos(lat))))


def haversine(x1, y1, x2, y2) -> Column:
    """Great-circle distance in metres of columns of degrees."""
    lat1, lat2 = F.radians(col(y1)), F.radians(col(y2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(F.radians(col(x2) - col(x1)) / 2), 2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def utm_code(lon, lat) -> Column:
    """EPSG code of the UTM zone of a point in degrees, with the exceptions of Norway and Svalbard; null beyond 84N or 80S."""
    x, y = col(lon).cast("double"), col(lat).cast("double")
    number = F.least(F.floor((x + 180) / 6) + 1, F.lit(60))
    number = F.when((y >= 56) & (y < 64) & (x >= 3) & (x < 12), F.lit(32)).otherwise(number)
    svalbard = (y >= 72) & (y <= 84)
    for low, high, z in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        number = F.when(svalbard & (x >= low) & (x < high), F.lit(z)).otherwise(number)
    return F.when((y <= 84) & (y >= -80), (number + F.when(y >= 0, 32600).otherwise(32700)).cast("int"))


def _series() -> tuple[float, list[float], list[float]]:
    n = _N
    a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return a, alpha, beta


class _Math:
    """The functions of the projection, on floats; ``_Sql`` has them on columns."""

    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, radians, degrees = map(staticmethod, (math.sin, math.cos, math.tan, math.atan, math.atan2, math.sinh, math.cosh, math.asinh, math.atanh, math.sqrt, math.radians, math.degrees))
    asin = staticmethod(math.asin)


class _Sql:
    sin, cos, tan, atan, atan2, sinh, cosh, asinh, atanh, sqrt, radians, degrees = map(staticmethod, (F.sin, F.cos, F.tan, F.atan, F.atan2, F.sinh, F.cosh, F.asinh, F.atanh, F.sqrt, F.radians, F.degrees))
    asin = staticmethod(F.asin)


def _to_utm(m, lon, lat, number: int, north: bool):
    a, alpha, _ = _series()
    e = math.sqrt(_E2)
    phi, lam = m.radians(lat), m.radians(lon - (6 * number - 183))
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        y = y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return 500_000 + _K0 * a * x, (0 if north else 10_000_000) + _K0 * a * y


def _from_utm(m, x, y, number: int, north: bool):
    a, _, beta = _series()
    xi0, eta0 = (y - (0 if north else 10_000_000)) / (_K0 * a), (x - 500_000) / (_K0 * a)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta - c * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    n = _N
    phi = chi
    for j, c in enumerate((2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15), 1):
        phi = phi + c * m.sin(2 * j * chi)
    return (6 * number - 183) + m.degrees(m.atan2(m.sinh(eta), m.cos(xi))), m.degrees(phi)


def _authalic(m, sine):
    e = math.sqrt(_E2)
    return (1 - _E2) * (sine / (1 - _E2 * sine * sine) + m.atanh(e * sine) / e)


def _albers() -> tuple[float, float, float, float]:
    """The cone's constant, C, the radius of the origin, and q at the pole, for parallels 29.5 and 45.5 and origin 23 N, 96 W."""
    sines = [math.sin(math.radians(d)) for d in (29.5, 45.5, 23.0)]
    m1, m2 = ((1 - s * s) / (1 - _E2 * s * s) for s in sines[:2])  # squares
    q1, q2, q0 = (_authalic(_Math, s) for s in sines)
    n = (m1 - m2) / (q2 - q1)
    c = m1 + n * q1
    return n, c, _A * math.sqrt(c - n * q0) / n, _authalic(_Math, 1.0)


def _to_albers(m, lon, lat):
    n, c, origin, _ = _albers()
    radius = _A / n * m.sqrt(c - n * _authalic(m, m.sin(m.radians(lat))))
    angle = n * m.radians(lon + 96.0)
    return radius * m.sin(angle), origin - radius * m.cos(angle)


def _from_albers(m, x, y):
    n, c, origin, pole = _albers()
    up = origin - y
    q = (c - (x * x + up * up) * (n / _A) ** 2) / n
    beta = m.asin(q / pole)
    e2, e4, e6 = _E2, _E2**2, _E2**3
    phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * m.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * m.sin(4 * beta) + 761 * e6 / 45360 * m.sin(6 * beta)
    sine = m.sin(phi)
    phi = phi + (q - _authalic(m, sine)) * (1 - _E2 * sine * sine) * (1 - _E2 * sine * sine) / (2 * (1 - _E2) * m.cos(phi))
    return m.degrees(m.atan2(x, up)) / n - 96.0, m.degrees(phi)


def _to_mercator(m, lon, lat):
    return _A * m.radians(lon), _A * m.asinh(m.tan(m.radians(lat)))


def _from_mercator(m, x, y):
    return m.degrees(x / _A), m.degrees(m.atan(m.sinh(y / _A)))


def _move(m, x, y, source, target):
    source, target = check(source), check(target)
    if source is None or target is None:
        raise MissingCRSError("reprojection needs both coordinate reference systems")
    if source == target:
        return x, y
    found = {5070: _from_albers, 3857: _from_mercator}.get(source)
    lon, lat = (x, y) if geographic(source) else found(m, x, y) if found else _from_utm(m, x, y, *zone(source))
    found = {5070: _to_albers, 3857: _to_mercator}.get(target)
    return (lon, lat) if geographic(target) else found(m, lon, lat) if found else _to_utm(m, lon, lat, *zone(target))


def reproject_point(x: float, y: float, source, target) -> tuple[float, float]:
    """A point in another system."""
    return _move(_Math, x, y, source, target)


def reproject(x, y, source, target) -> tuple[Column, Column]:
    """Columns of coordinates in another system, as closed formulas that stay in generated code."""
    return _move(_Sql, col(x).cast("double"), col(y).cast("double"), source, target)


@dataclass(frozen=True)
class Bounds:
    """Edges of a box."""

    left: float
    bottom: float
    right: float
    top: float
    crs: int | None = None

    @property
    def center(self) -> tuple[float, float]:
        return (self.left + self.right) / 2, (self.bottom + self.top) / 2

    @property
    def orientation(self) -> int:
        """Quadrant that the box lies in as seen from its (left, bottom): 1 for left<=right, bottom<=top."""
        right, up = self.left <= self.right, self.bottom <= self.top
        return {(True, True): 1, (False, True): 2, (False, False): 3, (True, False): 4}[right, up]

    def orient(self, quadrant: int = 1) -> Bounds:
        xs, ys = sorted((self.left, self.right)), sorted((self.bottom, self.top))
        if quadrant in (2, 3):
            xs.reverse()
        if quadrant in (3, 4):
            ys.reverse()
        return Bounds(xs[0], ys[0], xs[1], ys[1], self.crs)

    def width(self, units: str = "base") -> float:
        return base_to_units(self.crs, "x", abs(self.right - self.left), units, self.center[1])

    def height(self, units: str = "base") -> float:
        return base_to_units(self.crs, "y", abs(self.top - self.bottom), units)

    def buffer(self, distance: float = 0, units: str = "base", **edges: float) -> Bounds:
        """Grown outward by a distance, or by one for each edge."""
        size = {e: edges.get(e, distance) for e in ("left", "bottom", "right", "top")}
        if any(d < 0 for d in size.values()) or not any(size.values()):
            raise ValueError("a buffer has a positive distance")
        box, y = self.orient(1), self.center[1]
        x = lambda d: units_to_base(self.crs, "x", d, units, y)
        v = lambda d: units_to_base(self.crs, "y", d, units)
        return Bounds(box.left - x(size["left"]), box.bottom - v(size["bottom"]), box.right + x(size["right"]), box.top + v(size["top"]), self.crs).orient(self.orientation)

    def reproject(self, crs) -> Bounds:
        """The box around the four corners in another system."""
        points = [reproject_point(x, y, self.crs, crs) for x in (self.left, self.right) for y in (self.bottom, self.top)]
        xs, ys = zip(*points)
        return Bounds(min(xs), min(ys), max(xs), max(ys), check(crs)).orient(self.orientation)

    def utm_zone(self) -> int | None:
        """Code of the UTM zone at the centre."""
        lon, lat = reproject_point(*self.center, self.crs, 4326)
        if not -80 <= lat <= 84:
            return None
        return (32600 if lat >= 0 else 32700) + min(int((lon + 180) // 6) + 1, 60)

    def overlaps(self, other: Bounds) -> bool:
        a, b = self.orient(1), other.orient(1)
        return a.left < b.right and b.left < a.right and a.bottom < b.top and b.bottom < a.top

    def transform(self, nrows: int, ncols: int) -> Transform:
        return Transform((self.right - self.left) / ncols, (self.bottom - self.top) / nrows, self.left, self.top, self.crs)

    def todict(self) -> dict:
        return {"left": self.left, "bottom": self.bottom, "right": self.right, "top": self.top, "crs": self.crs}


@dataclass(frozen=True)
class Transform:
    """Pixel size and corner of a grid, without shear."""

    dx: float
    dy: float
    left: float
    top: float
    crs: int | None = None

    def __post_init__(self):
        if not self.dx or not self.dy or not all(map(math.isfinite, (self.dx, self.dy, self.left, self.top))):
            raise TransformError("a transform has finite edges and pixels of a size")
        object.__setattr__(self, "crs", check(self.crs))

    @property
    def orientation(self) -> int:
        return {(True, False): 1, (False, False): 2, (False, True): 3, (True, True): 4}[self.dx > 0, self.dy > 0]

    def resolution(self, units: str = "base", y: float | None = None) -> tuple[float, float]:
        """Width and height of a pixel."""
        return base_to_units(self.crs, "x", abs(self.dx), units, self.top if y is None else y), base_to_units(self.crs, "y", abs(self.dy), units)

    def pixel_area(self, units: str = "base", y: float | None = None) -> float:
        w, h = self.resolution(units, y)
        return w * h

    def pixel_diagonal(self, units: str = "base", y: float | None = None) -> float:
        return math.hypot(*self.resolution(units, y))

    def bounds(self, nrows: int, ncols: int) -> Bounds:
        return Bounds(self.left, self.top + nrows * self.dy, self.left + ncols * self.dx, self.top, self.crs)

    def shifted(self, row: int, col: int) -> Transform:
        return replace(self, left=self.left + col * self.dx, top=self.top + row * self.dy)

    def isclose(self, other: Transform, tolerance: float = 1e-9) -> bool:
        return compatible(self.crs, other.crs) and all(math.isclose(getattr(self, k), getattr(other, k), rel_tol=1e-9, abs_tol=tolerance) for k in ("dx", "dy", "left", "top"))

    def reproject(self, crs) -> Transform:
        """The transform of the corner pixel's two neighbours in another system."""
        x0, y0 = reproject_point(self.left, self.top, self.crs, crs)
        x1, y1 = reproject_point(self.left + self.dx, self.top + self.dy, self.crs, crs)
        return Transform(x1 - x0, y1 - y0, x0, y0, check(crs))

    def rowcol(self, x, y, rounding=F.floor) -> tuple[Column, Column]:
        """Row and column of coordinates."""
        return rounding((col(y) - self.top) / self.dy).cast("int"), rounding((col(x) - self.left) / self.dx).cast("int")

    def todict(self) -> dict:
        return {"dx": self.dx, "dy": self.dy, "left": self.left, "top": self.top, "crs": self.crs}
