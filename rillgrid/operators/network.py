"""Stream segment networks as tables.

``segments(id, child, start_row, start_col, end_row, end_col, next_row, next_col, n_pixels)`` has one row per segment, and
``pixels(id, ord, row, col)`` one per pixel. A segment's id is its first cell's id plus 1, which no other
segment can have and which needs no sequential pass; ``reference_order`` numbers segments 1..N along the streams.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import projection as P
from ..errors import SelectionError
from ..plans import doubling as D
from ..plans import tables, tiles
from ..raster import Meta, Raster
from .flow import STEPS, ahead, arrows, behind, directed, nodes


@dataclass(frozen=True)
class Network:
    """A stream network over a flow raster."""

    segments: DataFrame
    pixels: DataFrame
    flow: Raster

    @property
    def meta(self) -> Meta:
        return self.flow.meta

    def forest(self) -> DataFrame:
        return self.segments.select("id", F.col("child").alias("down"))

    def upstream(self, table: DataFrame, how: dict[str, str], moments: tuple[str, ...] = ()) -> DataFrame:
        """Columns of ``table(id, down, ..)``, whose rows are segments, folded over each and all above it, tile by tile: see ``tiles.upstream``."""
        return self._folded(table, lambda f: tiles.upstream(f, self.meta.ncols, how, moments=moments, anywhere=True))

    def downstream(self, table: DataFrame, how: dict[str, str]) -> DataFrame:
        """Columns of ``table(id, down, ..)`` folded over each segment and all below it."""
        return self._folded(table, lambda f: tiles.downstream(f, self.meta.ncols, how, anywhere=True))

    def _folded(self, table: DataFrame, fold) -> DataFrame:
        """A segment lies in the tile of its first cell, whose id is one less."""
        return fold(table.withColumn("id", F.col("id") - 1).withColumn("down", F.col("down") - 1)).withColumn("id", F.col("id") + 1)

    def size(self) -> int:
        return self.segments.count()

    def nlocal(self) -> int:
        """Number of local networks."""
        return self.segments.where("child is null").count()


def build(flow: Raster, mask: Raster, max_length: float = math.inf, units: str = "meters", check: bool = False) -> Network:
    """Segments of the cells in a mask: cut where streams meet, and into equal parts no longer than ``max_length``.

    A cell begins a segment unless exactly one cell of the mask drains to it. Every other cell joins the segment of
    that one cell, which is found for all cells at once, tile by tile.
    """
    spark = flow.cells.sparkSession
    work = tables.folder(spark)
    mask = flow.validate(mask, "mask").as_bool()

    def chains(window: tiles.Window) -> pa.Table:
        """Nodes of the streams, each with the single one that feeds it, if there is one: up the stream that is the next one "down" this path."""
        dir = directed(window)
        node = (dir > 0) & (window.values("mask") == 1)
        dir = np.where(node, dir, 0).astype(np.int8)
        single = behind(window, dir, node) == 1
        up = np.zeros(dir.shape, np.int8)  # the direction in which that one lies
        for d, (dr, dc) in STEPS.items():
            up[window.near(dir == d, -dr, -dc, False)] = (d + 3) % 8 + 1
        take = window.inner(node)
        found = nodes(window, window.inner(np.where(single, up, 0)), take)
        step = np.array([STEPS[d] for d in range(1, 9)])[window.inner(dir)[take] - 1]
        row, col = window.places(take)
        more = {"head": found["id"], "ord": pa.array(np.ones(len(row), np.int32)), "next_row": pa.array((row + step[:, 0]).astype(np.int32)), "next_col": pa.array((col + step[:, 1]).astype(np.int32))}
        return pa.table(found | more | {"on": pa.array(window.inner(ahead(window, dir, node, False))[take])})

    forest = tiles.forest({"flow": arrows(flow, check), "mask": mask.cells.where("value")}, tiles.Layout(flow.meta.shape, 1), chains, "id bigint, down bigint, row int, col int, head bigint, ord int, next_row int, next_col int, on boolean")
    placed = tiles.downstream(forest, flow.meta.ncols, {"head": "last", "ord": "sum"})
    pixels = tables.write(placed.select((F.col("head") + 1).alias("id"), (F.col("ord") - 1).alias("ord"), "row", "col", "next_row", "next_col", "on"), f"{work}/pixels")
    if max_length != math.inf:
        pixels = tables.write(_split(pixels, flow.meta, max_length, units), f"{work}/split")
    return Network(tables.write(_segments(pixels, flow.meta.ncols), f"{work}/segments"), pixels.select("id", "ord", "row", "col"), flow)


def _segments(pixels: DataFrame, ncols: int) -> DataFrame:
    """Segments of pixels; where the next cell is ``on`` the streams, a segment begins there, which is the child."""
    ends = pixels.groupBy("id").agg(
        F.min_by("row", "ord").alias("start_row"), F.min_by("col", "ord").alias("start_col"),
        F.max_by("row", "ord").alias("end_row"), F.max_by("col", "ord").alias("end_col"),
        F.max_by("next_row", "ord").alias("next_row"), F.max_by("next_col", "ord").alias("next_col"),
        F.max_by("on", "ord").alias("on"), F.count("*").alias("n_pixels"),
    )
    child = F.when(F.col("on"), F.col("next_row").cast("bigint") * ncols + F.col("next_col") + 1)
    return ends.select("id", child.alias("child"), "start_row", "start_col", "end_row", "end_col", "next_row", "next_col", "n_pixels")


def _lengths(pixels: DataFrame, meta: Meta, units: str) -> DataFrame:
    """Pixels with the length of the step to the next cell."""
    w, h = (1.0, 1.0) if meta.transform is None else meta.resolution(units) if units != "base" else (abs(meta.grid.dx), abs(meta.grid.dy))
    dr, dc = F.abs(F.col("next_row") - F.col("row")), F.abs(F.col("next_col") - F.col("col"))
    return pixels.withColumn("step", F.sqrt(F.pow(dr * h, 2) + F.pow(dc * w, 2)))


def _split(pixels: DataFrame, meta: Meta, max_length: float, units: str) -> DataFrame:
    """Segments longer than the maximum cut into equal parts; a pixel goes to the part that holds its centre."""
    order = Window.partitionBy("id").orderBy("ord")
    table = _lengths(pixels, meta, units).withColumn("at", F.sum("step").over(order) - F.col("step")).withColumn("total", F.sum("step").over(Window.partitionBy("id")))
    parts = F.ceil(F.col("total") / max_length)
    table = table.withColumn("part", F.least(F.floor(F.col("at") / (F.col("total") / parts) + 1e-9), parts - 1))
    own = Window.partitionBy("id", "part").orderBy("ord")
    first = F.first(F.col("row").cast("bigint") * meta.ncols + F.col("col")).over(own)
    return table.select((first + 1).alias("id"), (F.row_number().over(own) - 1).alias("ord"), "row", "col", "next_row", "next_col", "on")


def coordinates(network: Network) -> DataFrame:
    """``(id, coords)``: pixel centres in order, and the centre of the cell that follows."""
    t = network.meta.transform or P.Transform(1, 1, 0, 0)
    point = lambda row, col: F.struct((t.left + (F.col(col) + 0.5) * t.dx).alias("x"), (t.top + (F.col(row) + 0.5) * t.dy).alias("y"))
    own = network.pixels.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", point("row", "col").alias("p")))).alias("c"))
    joined = own.join(network.segments.select("id", "next_row", "next_col"), "id")
    return joined.select("id", F.concat(F.transform("c", lambda x: x["p"]), F.array(point("next_row", "next_col"))).alias("coords"))


def lengths(network: Network, units: str = "meters") -> DataFrame:
    """``(id, length)``."""
    nexts = Window.partitionBy("id").orderBy("ord")
    ends = network.pixels.join(network.segments.select("id", F.col("next_row").alias("__r"), F.col("next_col").alias("__c")), "id")
    steps = ends.withColumn("next_row", F.coalesce(F.lead("row").over(nexts), "__r")).withColumn("next_col", F.coalesce(F.lead("col").over(nexts), "__c"))
    return _lengths(steps, network.meta, units).groupBy("id").agg(F.sum("step").alias("length"))


def termini(network: Network) -> DataFrame:
    """``(id, terminus)``: the last segment of each one's local network."""
    return network.downstream(network.forest().withColumn("terminus", F.col("id")), {"terminus": "last"})


def is_terminal(network: Network) -> DataFrame:
    return network.segments.select("id", F.col("child").isNull().alias("is_terminal"))


def parents(network: Network) -> DataFrame:
    """``(id, parent)``."""
    return network.segments.where("child is not null").select(F.col("child").alias("id"), F.col("id").alias("parent"))


def children(network: Network) -> DataFrame:
    return network.segments.where("child is not null").select("id", "child")


def ancestors(network: Network) -> DataFrame:
    """``(id, ancestor)``: all pairs of a segment and one upstream of it."""
    return D.closure(network.forest()).where("id <> descendant").select(F.col("descendant").alias("id"), F.col("id").alias("ancestor"))


def descendents(network: Network) -> DataFrame:
    """``(id, descendent)``."""
    return D.closure(network.forest()).where("id <> descendant").select("id", F.col("descendant").alias("descendent"))


def family(network: Network) -> DataFrame:
    """``(id, terminus)`` once more: a local network is what shares a terminus."""
    return termini(network)


def outlets(network: Network, terminal: bool = False) -> DataFrame:
    """``(id, row, col)``: each segment's last pixel, or that of its terminus."""
    own = network.segments.select("id", F.col("end_row").alias("row"), F.col("end_col").alias("col"))
    if not terminal:
        return own
    return termini(network).join(own.withColumnRenamed("id", "terminus"), "terminus").select("id", "row", "col")


def check_ids(network: Network, ids: DataFrame) -> DataFrame:
    """``ids(id)``, or an error if one is not in the network."""
    missing = ids.join(network.segments, "id", "left_anti").first()
    if missing is not None:
        raise SelectionError(f"segment {missing['id']} is not in the network")
    return ids.select("id").distinct()


def continuous(network: Network, selected: DataFrame, remove: bool = False, keep_upstream: bool = False, keep_downstream: bool = False) -> DataFrame:
    """``(id)`` of the segments kept, of a selection ``(id)`` to keep (or remove) that may not break a stream in two.

    A segment asked to go goes only if all below it are asked to go, too, or all above it: two folds over the forest.
    """
    chosen = check_ids(network, selected).withColumn("__chosen", F.lit(True))
    table = network.forest().join(chosen, "id", "left")
    gone = F.coalesce("__chosen", F.lit(False))
    table = table.select("id", "down", (gone if remove else ~gone).alias("asked"))
    below = network.downstream(table.withColumn("all_below", F.col("asked")), {"all_below": "both"})
    above = network.upstream(table.withColumn("stays", (~F.col("asked")).cast("long")), {"stays": "sum"}).select("id", "stays")
    goes = F.lit(False)
    goes = goes if keep_downstream else goes | F.col("all_below")
    goes = goes if keep_upstream else goes | (F.col("stays") == 0)
    return below.join(above, "id").where(~(F.col("asked") & goes)).select("id")


def keep(network: Network, ids: DataFrame) -> Network:
    """The network of the segments given; links to others are dropped, ids and pixels stay."""
    left = tables.write(check_ids(network, ids), f"{tables.folder(ids.sparkSession)}/ids")
    segments = network.segments.join(left, "id", "left_semi")
    known = left.select(F.col("id").alias("child"), F.lit(True).alias("__known"))
    segments = segments.join(known, "child", "left").withColumn("child", F.when(F.col("__known"), F.col("child"))).drop("__known")
    return replace(network, segments=segments.select(*network.segments.columns), pixels=network.pixels.join(left, "id", "left_semi"))


def remove(network: Network, ids: DataFrame) -> Network:
    """The network without the segments given."""
    return keep(network, network.segments.select("id").join(check_ids(network, ids), "id", "left_anti"))


def stream_raster(network: Network) -> Raster:
    """Segment ids on the grid, 0 elsewhere."""
    own = network.pixels.groupBy("row", "col").agg(F.max("id").alias("value"))
    rows = network.flow.cells.select("row", "col").join(own, ["row", "col"], "left")
    return Raster(rows.select("row", "col", F.coalesce("value", F.lit(0)).alias("value")), network.meta.update(dtype="int64", nodata=0))


def _labelled(network: Network, ends: DataFrame, how: str) -> DataFrame:
    """``(row, col, label)`` of all cells of the flow raster: the first or the last label that ``ends(row, col, value)`` has on each one's way."""

    def labels(window: tiles.Window) -> pa.Table:
        dir, take = directed(window), window.there("flow")
        label = window.values("label")[take]
        none = np.isnan(label) | (dir[take] == 0)
        return pa.table(nodes(window, dir, take) | {"label": pa.array(np.where(none, 0, label).astype(np.int64), mask=none)})

    forest = tiles.forest({"flow": arrows(network.flow), "label": ends}, tiles.Layout(network.meta.shape), labels, "id bigint, down bigint, row int, col int, label bigint")
    return tiles.downstream(forest, network.meta.ncols, {"label": how}).select("row", "col", "label")


def cell_segments(network: Network) -> DataFrame:
    """``(row, col, id)``: every cell that drains to a segment's outlet, with the first outlet on its way."""
    ends = network.segments.select(F.col("end_row").alias("row"), F.col("end_col").alias("col"), F.col("id").alias("value"))
    return _labelled(network, ends, "first").where("label is not null").select("row", "col", F.col("label").alias("id"))


def _terminal(network: Network) -> DataFrame:
    return network.segments.where("child is null").select(F.col("end_row").alias("row"), F.col("end_col").alias("col"), F.col("id").alias("value"))


def basins(network: Network) -> DataFrame:
    """``(row, col, basin)``: every cell that drains to a terminal outlet, with the last one on its way."""
    return _labelled(network, _terminal(network), "last").where("label is not null").select("row", "col", F.col("label").alias("basin"))


def basin_raster(network: Network) -> Raster:
    """Basins' ids on the grid, 0 elsewhere."""
    rows = _labelled(network, _terminal(network), "last")
    return Raster(rows.select("row", "col", F.coalesce("label", F.lit(0)).alias("value")), network.meta.update(dtype="int64", nodata=0))


def is_nested(network: Network) -> DataFrame:
    """``(id, is_nested)``: whether a segment's local network drains into another one."""
    at = tiles.beside({"terminus": _terminal(network), "basin": basins(network).withColumnRenamed("basin", "value")}, network.meta.shape)
    return termini(network).join(at, "terminus").select("id", (F.col("basin") != F.col("terminus")).alias("is_nested"))


def catchment_mask(network: Network, id: int) -> Raster:
    """The cells that drain to a segment's outlet."""
    from .flow import catchment

    end = outlets(network).where(F.col("id") == id).first()
    if end is None:
        raise SelectionError(f"segment {id} is not in the network")
    return catchment(network.flow, end["row"], end["col"])


def reference_order(network: Network) -> DataFrame:
    """``(id, number)``: 1..N by walking down from the heads in row-major order, past a confluence once all above it are done.

    The walk is sequential by nature; it runs over the table of segments in one task, for networks of modest size.
    """
    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        child = dict(zip(pdf.id, pdf.child))
        waiting = pdf.child.dropna().value_counts().to_dict()
        out = []
        heads = pdf[~pdf.id.isin(set(pdf.child.dropna()))].sort_values(["start_row", "start_col"])
        for head in heads.id:
            at = head
            while True:
                out.append(at)
                below = child[at]
                if pd.isna(below):
                    break
                waiting[below] -= 1
                if waiting[below]:
                    break
                at = int(below)
        return pd.DataFrame({"id": out, "number": range(1, len(out) + 1)})

    table = network.segments.select("id", "child", "start_row", "start_col", F.lit(1).alias("g"))
    return table.groupBy("g").applyInPandas(walk, "id bigint, number int")
