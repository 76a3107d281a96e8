"""Plans that hold at size: no table of cells is broadcast, cells meet by tile, and tables of any length give what SQL gives."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from rillgrid.plans import doubling, tables, tiles

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    """The plan of a query as it begins; what it reads is made first."""
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d8_flow", "relief"])
def test_neighbours_meet_without_joins(spark, name):
    text = plan(spark, name)
    assert "hashpartitioning(row" not in text and "Broadcast" not in text


@pytest.mark.parametrize("name", ["resample_nearest", "resample_cubic", "resample_cubic_spline"])
def test_cells_of_a_made_grid_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(spark, name)


def test_written_tables_are_not_broadcast(spark):
    """A compressed file of a few MB can hold millions of rows."""
    table = tables.write(spark.range(100).selectExpr("id", "id + 1 as down"), f"{tables.folder(spark)}/t")
    joined = table.join(table.selectExpr("id as down", "down as next"), "down", "left")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["segment_summary_max", "isnested", "catchment_summary_mean", "confinement", "basins_raster", "remove_segments", "sine_theta", "m1_variables", "m2_variables"])
def test_cells_meet_by_tile(spark, name):
    text = plan(spark, name)
    assert "hashpartitioning(row" not in text and "Broadcast" not in text


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Terrains of 401 and 402 rows, no multiples of four."""
    out = {}
    for n in (401, 402):
        out[n] = str(tmp_path_factory.mktemp(f"rows{n}"))
        table = pq.read_table(f"{SF}/embeddings.parquet")
        pq.write_table(table.filter(pc.less(table["vec_id"], n)), f"{out[n]}/embeddings.parquet")
    return out


@pytest.mark.parametrize("rows, name", [(402, "nearest"), (401, "nearest"), (401, "bilinear"), (401, "cubic"), (401, "cubic_spline")])
def test_resampling_of_rows_that_are_no_multiple_of_four(spark, odd, rows, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{odd[rows]}/embeddings.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[f"resample_{name}"]).fetchall()
    got = __spark_entry__.queries()[f"resample_{name}"](spark, odd[rows]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("size", [2, 8, 64])
def test_forests_that_lead_anywhere(spark, size):
    """Folds over a forest whose nodes lie far from the next ones, tile by tile, against path doubling."""
    rng = np.random.default_rng(size)
    ids = np.sort(rng.choice(400, 150, replace=False))
    down = [int(rng.choice(ids[k + 1 :])) if k + 1 < len(ids) and rng.random() < 0.9 else None for k in range(len(ids))]
    n, mean = rng.integers(0, 4, len(ids)), rng.normal(1e6, 1, len(ids))
    columns = {"id": ids, "down": pa.array(down, pa.int64()), "s": rng.integers(0, 9, len(ids)), "x_n": n, "x_mean": np.where(n > 0, mean, 0), "x_m2": np.where(n > 1, rng.random(len(ids)), 0), "label": ids}
    forest = spark.createDataFrame(pa.table(columns))
    by_id = lambda df, *c: {r.id: tuple(r[x] for x in c) for r in df.collect()}
    got = by_id(tiles.upstream(forest, 20, {"s": "sum"}, size, moments=("x",), anywhere=True), "s", "x_n", "x_mean", "x_m2")
    want = by_id(doubling.upstream(forest, {"s": doubling.SUM}, ("x",)), "s", "x_n", "x_mean", "x_m2")
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k][:2] == row[:2]
        assert row[1] == 0 or np.allclose(got[k][2:], row[2:], rtol=1e-12, atol=1e-5)  # of nothing there is no mean
    got = by_id(tiles.downstream(forest, 20, {"label": "last"}, size, anywhere=True), "label")
    assert got == by_id(doubling.downstream(forest, {"label": doubling.last}), "label")
