"""Clients of public map services: product catalogues, tiles, job services and tables.

A client takes the service's address and a ``fetch(url, params, timeout) -> (status, bytes)``, by default one over urllib, so that it
runs on the driver, is tested without a network, and can go through any proxy. What is downloaded is read by the sources of this package.
"""

from __future__ import annotations

import io
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidJSONError, JobError, JobTimeoutError, MissingFieldError, NoProductsError, ServiceError, TooManyProductsError
from ..projection import Bounds

Fetch = Callable[[str, dict, float], tuple[int, bytes]]
PAGE, MOST = 500, 1000


def fetch_url(url: str, params: dict, timeout: float = 15) -> tuple[int, bytes]:
    """GET by urllib."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    if not full.startswith(("http://", "https://")):
        raise ValueError(f"{url} is not an http address")
    try:
        with urllib.request.urlopen(full, timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


class Client:
    """Requests to one service, with its errors typed."""

    def __init__(self, url: str, fetch: Fetch = fetch_url, timeout: float = 15, attempts: int = 1):
        if timeout is not None and timeout <= 0:
            raise ValueError("a timeout is positive")
        self.url, self.fetch, self.timeout, self.attempts = url.rstrip("/"), fetch, timeout, attempts

    def content(self, path: str = "", **params) -> bytes:
        url = path if "://" in path else f"{self.url}{path}"
        failure: Exception | None = None
        for _ in range(self.attempts):
            try:
                status, body = self.fetch(url, params, self.timeout)
            except OSError as error:
                failure = ServiceError(f"{url} can't be reached: {error}")
                continue
            if status < 400:
                return body
            failure = ServiceError(f"{url} answered {status}")
            if status < 500:
                break
        raise failure or ServiceError(url)

    def json(self, path: str = "", **params) -> dict:
        body = self.content(path, **params)
        try:
            return json.loads(body)
        except ValueError as error:
            raise InvalidJSONError(f"{self.url}{path} answered no JSON") from error

    def download(self, target: str | Path, path: str = "", overwrite: bool = False, **params) -> Path:
        target = Path(target)
        if target.exists() and not overwrite:
            raise FileExistsError(target)
        target.write_bytes(self.content(path, **params))
        return target

    def unzip(self, target: str | Path, path: str = "", item: str | None = None, **params) -> Path:
        """Downloads an archive and unpacks it, or one item of it."""
        target = Path(target)
        if target.exists():
            raise FileExistsError(target)
        with zipfile.ZipFile(io.BytesIO(self.content(path, **params))) as archive:
            target.mkdir(parents=True)
            for name in archive.namelist():
                if item is not None and not name.startswith(item):
                    continue
                if not (target / name).resolve().is_relative_to(target.resolve()):
                    raise ServiceError(f"{name} leads out of the archive")
                archive.extract(name, target)
        return target if item is None else target / item


def field(answer: dict, name: str, what: str = "answer"):
    """A field that must be there."""
    if name not in answer:
        raise MissingFieldError(f"the {what} has no field {name}")
    return answer[name]


def bounds_text(bounds: Bounds, delimiter: str = ",") -> str:
    """Edges in degrees."""
    b = bounds.reproject(4326).orient(1)
    return delimiter.join(map(str, (b.left, b.bottom, b.right, b.top)))


def unit_code(code: str) -> str:
    """A hydrologic unit code of 2, 4 or 8 digits."""
    if not re.fullmatch(r"\d{2}|\d{4}|\d{8}", str(code)):
        raise ValueError("a hydrologic unit has 2, 4 or 8 digits")
    return str(code)


class Catalogue(Client):
    """A paged catalogue of products."""

    def query(self, datasets: list[str] | str, *, bounds: Bounds | None = None, unit: str | None = None, formats: list[str] | str | None = None, limit: int = PAGE, offset: int = 0) -> dict:
        """One page. A page's size is sent as a multiple of 5, which the service asks for."""
        if not 0 < limit <= MOST or offset < 0:
            raise ValueError(f"a page has 1 to {MOST} products, from 0 on")
        names = lambda x: x if isinstance(x, str) else ",".join(x)
        params: dict = {"datasets": names(datasets), "max": -(-limit // 5) * 5, "offset": offset, "outputFormat": "JSON"}
        if bounds is not None:
            params["bbox"] = bounds_text(bounds)
        if unit is not None:
            params |= {"polyType": f"huc{len(unit_code(unit))}", "polyCode": unit}
        if formats is not None:
            params["prodFormats"] = names(formats)
        answer = self.json(**params)
        if answer.get("errors") or answer.get("error"):
            raise ServiceError(f"the catalogue reports {answer.get('errors') or answer.get('error')}")
        return answer

    def count(self, datasets, **options) -> int:
        total = field(self.query(datasets, limit=5, **options), "total")
        if not isinstance(total, int):
            raise MissingFieldError("the catalogue's total is not a number")
        return total

    def products(self, datasets, *, max_products: int | None = None, max_queries: int | None = None, page: int = PAGE, offset: int = 0, strict: bool = True, **options) -> list[dict]:
        """All products, page by page, each page with the same options."""
        found: list[dict] = []
        queries = 0
        while True:
            answer = self.query(datasets, limit=page, offset=offset + len(found), **options)
            queries += 1
            total = field(answer, "total") - offset
            if total <= 0:
                if strict:
                    raise NoProductsError("nothing matches")
                return []
            if max_products is not None and total > max_products:
                raise TooManyProductsError(f"{total} products match, more than {max_products}")
            items = field(answer, "items")[:page]
            found += items
            if len(found) >= total or not items:
                return found[:total]
            if max_queries is not None and queries >= max_queries:
                raise TooManyProductsError(f"{total} products need more than {max_queries} queries")

    def tiles(self, spark: SparkSession, datasets, **options) -> DataFrame:
        """Products as a table: title, date, address, size and edges."""
        rows = []
        for p in self.products(datasets, **options):
            box = field(p, "boundingBox", "product")
            rows.append((field(p, "title"), field(p, "publicationDate"), field(p, "downloadURL"), p.get("sizeInBytes"), p.get("format"), p.get("extent"), float(box["minX"]), float(box["minY"]), float(box["maxX"]), float(box["maxY"])))
        table = spark.createDataFrame(rows, "title string, published string, url string, nbytes bigint, format string, extent string, left double, bottom double, right double, top double")
        return table.withColumn("published", table.published.cast("date"))

    def one(self, datasets, title: str, **options) -> dict:
        """The product whose title holds some words."""
        for p in self.products(datasets, **options):
            if title.lower() in field(p, "title").lower():
                return p
        raise NoProductsError(f"no product is named {title}")


class Jobs(Client):
    """A service that makes an archive of layers within bounds as a job."""

    def submit(self, layers: list[str] | str, bounds: Bounds) -> str:
        named = layers if isinstance(layers, str) else ";".join(layers)
        return field(self.json("/submitJob", f="json", Layer_List=named, Area_of_Interest=bounds_text(bounds, " ")), "jobId", "job")

    def status(self, job: str) -> str:
        return field(self.json(f"/jobs/{job}", f="json"), "jobStatus", "job")

    def wait(self, job: str, most: float = 60, every: float = 15, sleep: Callable[[float], None] = time.sleep) -> dict:
        """The finished job; an error if it fails or takes too long."""
        if every <= 0 or most <= 0:
            raise ValueError("times are positive")
        waited = 0.0
        while True:
            answer = self.json(f"/jobs/{job}", f="json")
            state = field(answer, "jobStatus", "job").removeprefix("esriJob")
            if state == "Succeeded":
                return answer
            if state not in ("New", "Submitted", "Waiting", "Executing"):
                raise JobError(f"job {job} ended as {state}: {answer.get('messages')}")
            if waited >= most:
                raise JobTimeoutError(f"job {job} took more than {most} seconds")
            sleep(every)
            waited += every

    def archive(self, layers, bounds: Bounds, target: str | Path, **waiting) -> Path:
        """Submits, waits, and unpacks what the job made."""
        job = self.submit(layers, bounds)
        results = field(self.wait(job, **waiting), "results", "job")
        link = field(field(results, "Output_File", "results"), "paramUrl", "result")
        url = field(field(self.json(f"/jobs/{job}/{link}", f="json"), "value", "result"), "url", "value")
        return self.unzip(target, url)


STATISTICS = {"mean": "fe_text_mean.csv", "upper": "fe_text_uppr.csv", "lower": "fe_text_lwr.csv", "all": "fe_text.csv"}


class Precipitation(Client):
    """Precipitation frequencies at a point, as CSV."""

    def table(self, spark: SparkSession, lat: float, lon: float, statistic: str = "mean", data: str = "depth", series: str = "pds", units: str = "metric") -> DataFrame:
        """``(duration, interval, value)``; durations in words, intervals in years."""
        for value, allowed in ((statistic, STATISTICS), (data, ("depth", "intensity")), (series, ("pds", "ams")), (units, ("metric", "english"))):
            if value not in allowed:
                raise ValueError(f"{value} is not one of {', '.join(allowed)}")
        if not -90 <= lat <= 90 or not -180 <= lon <= 180:
            raise ValueError("no such place")
        text = self.content("/" + STATISTICS[statistic], lat=lat, lon=lon, data=data, series=series, units=units).decode()
        rows, intervals = [], []
        for line in text.splitlines():
            parts = [p.strip() for p in line.replace(":,", ",").rstrip(":").split(",")]
            if line.lower().startswith("by duration"):
                intervals = [float(re.sub(r"[^0-9.]", "", p.split("/")[-1])) for p in parts[1:] if p]
            elif intervals and re.match(r"\d+-(min|hr|day)", parts[0]):
                rows += [(parts[0], i, float(v)) for i, v in zip(intervals, parts[1:])]
        return spark.createDataFrame(rows, "duration string, interval double, value double")


SOIL_FIELDS = {"KFFACT": ("Soil KF-factors", "inches per hour"), "THICK": ("Soil thickness", "inches")}


class Soil(Client):
    """Soil rasters of a catalogue item, one file for each field."""

    def fields(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *v) for k, v in SOIL_FIELDS.items()], "field string, description string, units string")

    def address(self, field_name: str, item: str) -> str:
        """Where a field's file lies."""
        if field_name.upper() not in SOIL_FIELDS:
            raise ValueError(f"{field_name} is not one of {', '.join(SOIL_FIELDS)}")
        files = field(self.json(f"/{item}", format="json"), "files", "item")
        for f in files:
            if f.get("name", "").lower().endswith(f"{field_name.lower()}.tif"):
                return field(f, "url", "file")
        raise MissingFieldError(f"the item has no file of {field_name}")
