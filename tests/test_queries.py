import duckdb
import pytest

import __spark_entry__
from rillgrid import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["slope_conversions", "haversine", "reproject_round_trip", "severity_estimate", "raster_clip_exterior", "raster_mosaic", "resample_average", "rasterize_polygons", "d8_flow", "accumulation_nodata", "relief", "network_links", "continuous_filter", "isnested", "catchment_summary_nanstd", "m1_variables", "confinement", "threshold_m1", "volume_emergency", "hazard"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: repr(v) if isinstance(v, (bool, str)) or v is None else repr(float(v))
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    table = queries.queries()[name](spark, DATA)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(table.columns) == sorted(names)
    assert plain([tuple(r) for r in table.collect()], table.columns) == plain(cursor.fetchall(), names)


def test_registry():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(queries.queries()) <= set(found)
