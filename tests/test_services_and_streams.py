import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rillgrid.errors import InvalidJSONError, JobError, JobTimeoutError, MissingFieldError, NoProductsError, ServiceError, TooManyProductsError
from rillgrid.functions import hazard, likelihood, volume
from rillgrid.projection import Bounds
from rillgrid.sources import services
from rillgrid.streaming import storms

BOX = Bounds(-118, 34, -117, 35, 4326)


def canned(*answers):
    asked = []

    def fetch(url, params, timeout):
        asked.append((url, params))
        answer = answers[min(len(asked), len(answers)) - 1]
        status, body = answer if isinstance(answer, tuple) else (200, answer)
        return status, body if isinstance(body, bytes) else json.dumps(body).encode()

    return fetch, asked


def product(k):
    return {"title": f"tile {k}", "publicationDate": "2020-02-03", "downloadURL": f"http://x/{k}", "sizeInBytes": k, "format": "GeoTIFF", "extent": "1", "boundingBox": {"minX": k, "minY": 0, "maxX": k + 1, "maxY": 1}}


def test_catalogue(spark):
    fetch, asked = canned({"total": 7, "items": [product(k) for k in range(5)]}, {"total": 7, "items": [product(5), product(6)]})
    rows = services.Catalogue("http://api", fetch).tiles(spark, "dem", bounds=BOX, formats="GeoTIFF", page=5).orderBy("left").collect()
    assert len(rows) == 7 and str(rows[3].published) == "2020-02-03" and rows[3].left == 3
    assert [p["offset"] for _, p in asked] == [0, 5] and all(p["prodFormats"] == "GeoTIFF" and p["bbox"] == "-118,34,-117,35" for _, p in asked)
    with pytest.raises(TooManyProductsError):
        services.Catalogue("http://api", canned({"total": 7, "items": []})[0]).products("dem", max_products=3)
    with pytest.raises(NoProductsError):
        services.Catalogue("http://api", canned({"total": 0, "items": []})[0]).products("dem")
    with pytest.raises(ValueError):
        services.Catalogue("http://api", fetch).query("dem", unit="123")
    with pytest.raises(MissingFieldError):
        services.Catalogue("http://api", canned({"items": []})[0]).count("dem")


def test_failures():
    with pytest.raises(InvalidJSONError):
        services.Client("http://api", canned(b"<html>")[0]).json()
    with pytest.raises(ServiceError, match="404"):
        services.Client("http://api", canned((404, b""))[0]).content()
    assert services.Client("http://api", canned((503, b""), b"fine")[0], attempts=2).content() == b"fine"


def test_jobs(tmp_path):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("data.tif", b"x")
    link = {"jobStatus": "esriJobSucceeded", "results": {"Output_File": {"paramUrl": "results/Output_File"}}}
    fetch, _ = canned({"jobId": "j1"}, {"jobStatus": "esriJobExecuting"}, link, {"value": {"url": "http://x/out.zip"}}, blob.getvalue())
    folder = services.Jobs("http://jobs", fetch).archive(["a", "b"], BOX, tmp_path / "out", every=1, sleep=lambda s: None)
    assert (folder / "data.tif").read_bytes() == b"x"
    with pytest.raises(JobError):
        services.Jobs("http://jobs", canned({"jobStatus": "esriJobFailed"})[0]).wait("j")
    with pytest.raises(JobTimeoutError):
        services.Jobs("http://jobs", canned({"jobStatus": "esriJobWaiting"})[0]).wait("j", most=2, every=1, sleep=lambda s: None)


def test_tables(spark):
    text = b"Point precipitation frequency\nby duration for ARI (years):, 1,2,5\n5-min:, 1.5,2.5,3.5\n15-min:, 2,3,4\n"
    got = services.Precipitation("http://p", canned(text)[0]).table(spark, 34, -118)
    assert {(r.duration, r.interval, r.value) for r in got.collect()} >= {("5-min", 1.0, 1.5), ("15-min", 5.0, 4.0)}
    soil = services.Soil("http://s", canned({"files": [{"name": "a.xml"}, {"name": "x-KFFACT.tif", "url": "http://s/k.tif"}]})[0])
    assert soil.address("kffact", "item") == "http://s/k.tif" and soil.fields(spark).count() == 2


def test_stream_is_scored_like_a_batch(spark, tmp_path):
    segments = spark.createDataFrame([(1, "a", 0.2, 0.3, 0.4, 0.5, 300.0), (2, "a", 0.9, 0.9, 0.9, 5.0, 900.0), (3, "b", 0.0, 0.1, 0.1, 0.0, 10.0)], "id long, region string, t double, f double, s double, bmh double, relief double")
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a", 24.0), (2, "2024-01-01 00:20:00", "b", 60.0), (3, "2024-01-01 00:21:00", "a", None)], "storm_id long, ts string, region string, i15 double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    batch = storms.score(rows, segments)
    assert batch.count() == 3
    r = batch.where("id = 2").first()
    _, b, ct, cf, cs = likelihood.parameters("M1", (15,))[0]
    want = spark.range(1).select(likelihood.likelihood(6.0, b, ct, 0.9, cf, 0.9, cs, 0.9).alias("p"), F.exp(volume.emergency_ln(24.0, 5.0, 900.0)).alias("v")).withColumn("h", hazard.hazard("p", "v")).first()
    assert (r.likelihood, r.volume, float(r.hazard)) == (pytest.approx(want.p), pytest.approx(want.v), want.h)
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = storms.score(live, segments).writeStream.format("memory").queryName("scored").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = lambda t: sorted((x.id, x.storm_id, round(x.likelihood, 9), x.hazard) for x in t.collect())
    assert key(spark.table("scored")) == key(batch)
    assert storms.alerts(batch).count() == 2
