"""Aggregates along the paths of a forest of cells, tile by tile.

The grid is cut into tiles. A first pass solves each tile in one task and writes its cells once, as one row, beside what matters to other
tiles: for cells on its edge, where a path that enters there leaves the tile and what it gathers on its way. These make a
forest smaller than the cells by the tile's width, which path doubling solves. A second pass adds what comes in, and
solves each tile again. Cells are shuffled twice, however long the paths are.

Rasters of one grid meet in tiles, too: ``gather`` packs their cells where they are read, a few bytes each, and brings them
together by one shuffle of the packs, with as wide a margin around each tile as is asked for. So neighbours need no join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import CycleError
from . import doubling as D
from . import tables

TILE = 1024
#: Cells that a task packs at a time.
PACK = 1 << 18

#: How each operation joins what is near with what is farther along, as columns; the arrays' way is in ``_join`` and ``_gather``.
_COLUMNS = {"sum": D.SUM, "max": D.MAX, "min": D.MIN, "first": (None, D.first), "last": (None, D.last), "either": (None, D.either), "both": (None, D.both)}


# --- rasters by tile -----------------------------------------------------------------------------
_PACKED = "tile bigint, grid int, n int, `at` binary, v binary, lost binary"


def _squeezed(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array), codec="zstd", asbytes=True)


def _spread(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd"), kind)


@dataclass(frozen=True)
class Layout:
    """A grid's shape, the tiles it is cut into and the margin that each is given."""

    shape: tuple[int, int]
    halo: int = 0
    size: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "size", self.size or TILE)

    @property
    def wide(self) -> int:
        return -(-self.shape[1] // self.size)

    def corner(self, tile: int) -> tuple[int, int]:
        return tile // self.wide * self.size, tile % self.wide * self.size

    def pack(self, table: pa.Table, grid: int) -> pa.RecordBatch:
        """One row for each tile that cells lie in or near: their places in the tile as differences, and their values."""
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        column = table["value"].combine_chunks()
        lost = ~column.is_valid().to_numpy(zero_copy_only=False)
        value = column.fill_null(0.0).to_numpy(zero_copy_only=False)
        h, size = self.halo, self.size
        pitch, reach = size + 2 * h, -(-h // size)

        def near(at: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Along one axis, for tiles so many away: whether a cell lies in or near the tile, which one that is, and the place there."""
            out = []
            for k in range(-reach, reach + 1):
                tile = at // size + k
                place = at - tile * size + h
                out.append(((at >= 0) & (at < n) & (tile >= 0) & (tile * size < n) & (place >= 0) & (place < pitch), tile, place))
            return out

        found = []
        down, across = near(row, self.shape[0]), near(col, self.shape[1])
        for in_row, tr, r in down:
            for in_col, tc, c in across:
                which = np.flatnonzero(in_row & in_col)
                found.append((tr[which] * self.wide + tc[which], r[which] * pitch + c[which], which))
        tile, place, which = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((place, tile))
        tile, place, which = tile[order], place[order], which[order]
        begins = np.flatnonzero(np.concatenate((np.ones(min(len(tile), 1), bool), tile[1:] != tile[:-1])))
        rows = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(tile)]):
            own = which[a:b]
            rows.append((int(tile[a]), grid, b - a, _squeezed(np.diff(place[a:b], prepend=0).astype(np.int32)), _squeezed(value[own]), _squeezed(lost[own]) if lost[own].any() else None))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = zip(*rows) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["tile", "grid", "n", "at", "v", "lost"])


class Window:
    """One tile of several rasters with its margin, as arrays."""

    def __init__(self, parts: pa.Table, layout: Layout, names: list[str]):
        self.parts, self.layout, self.names = parts, layout, names
        self.top, self.left = layout.corner(parts["tile"][0].as_py())
        self.rows, self.cols = min(layout.size, layout.shape[0] - self.top), min(layout.size, layout.shape[1] - self.left)
        pitch = layout.size + 2 * layout.halo
        self._shape = (self.rows + 2 * layout.halo, self.cols + 2 * layout.halo)
        self._values: dict[str, np.ndarray] = {}
        self._state = {n: np.zeros(self._shape, np.uint8) for n in names}
        for n in names:
            self._values[n] = np.full(self._shape, np.nan)
        for k in range(parts.num_rows):
            name, n = names[parts["grid"][k].as_py()], parts["n"][k].as_py()
            at = np.divmod(np.cumsum(_spread(parts["at"][k].as_py(), n, np.int32)), pitch)
            value, lost = _spread(parts["v"][k].as_py(), n, np.float64), parts["lost"][k].as_py()
            state = np.ones(n, np.uint8) if lost is None else 1 + _spread(lost, n, np.uint8)
            self._values[name][at] = value if lost is None else np.where(state == 2, np.nan, value)
            self._state[name][at] = state

    def values(self, name: str) -> np.ndarray:
        """Values with the margin, NaN where there is no cell or it is null."""
        return self._values[name]

    def there(self, name: str) -> np.ndarray:
        return self._state[name] > 0

    def null(self, name: str) -> np.ndarray:
        return self._state[name] == 2

    def inner(self, array: np.ndarray, margin: int | None = None) -> np.ndarray:
        """An array without the margin, or without so much of it."""
        h = self.layout.halo if margin is None else margin
        return array[h : array.shape[0] - h, h : array.shape[1] - h]

    def near(self, array: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
        """For each place what lies a step from it."""
        out = np.full_like(array, fill)
        rows, cols = array.shape
        out[max(0, -dr) : rows - max(0, dr), max(0, -dc) : cols - max(0, dc)] = array[max(0, dr) : rows - max(0, -dr), max(0, dc) : cols - max(0, -dc)]
        return out

    def places(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the raster where an array without margin is true."""
        r, c = np.nonzero(take)
        return r + self.top, c + self.left


@dataclass(frozen=True)
class Gathered:
    """A forest of cells that each tile makes from rasters: ``make`` gives a window's nodes, with the columns of ``schema``."""

    packs: DataFrame
    layout: Layout
    names: list[str]
    make: Callable[[Window], pa.Table]
    schema: StructType


def gather(grids: dict[str, DataFrame], layout: Layout) -> DataFrame:
    """``(tile, grid, n, at, v, lost)``: cells ``(row, col, value)`` of several rasters, packed by tile."""
    out = None
    for k, cells in enumerate(grids.values()):
        def pack(batches: Iterator[pa.RecordBatch], k=k):
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= PACK:
                    yield layout.pack(pa.Table.from_batches(held), k)
                    held, n = [], 0
            if n:
                yield layout.pack(pa.Table.from_batches(held), k)

        packs = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).mapInArrow(pack, _PACKED)
        out = packs if out is None else out.unionByName(packs)
    return out


def stencil(grids: dict[str, DataFrame], layout: Layout, make: Callable[[Window], pa.Table], schema: str) -> DataFrame:
    """What ``make`` gives for each tile of the rasters, by one shuffle of their packed cells."""
    names = list(grids)
    return gather(grids, layout).groupBy("tile").applyInArrow(lambda parts: make(Window(parts, layout, names)), schema)


def forest(grids: dict[str, DataFrame], layout: Layout, make: Callable[[Window], pa.Table], schema: str) -> Gathered:
    """A forest for ``upstream`` or ``downstream`` that each tile makes from rasters, without a table of its nodes."""
    return Gathered(gather(grids, layout), layout, list(grids), make, StructType.fromDDL(schema))


def beside(grids: dict[str, DataFrame], shape: tuple[int, int]) -> DataFrame:
    """``(row, col, ..)``: cells that all rasters have, with a column for each raster's ``value``; tile by tile."""
    kinds = {name: dict(cells.dtypes)["value"] for name, cells in grids.items()}

    def make(window: Window) -> pa.Table:
        take = np.logical_and.reduce([window.there(n) for n in kinds])
        row, col = window.places(take)
        columns = [pa.array(window.values(n)[take], mask=window.null(n)[take]) for n in kinds]
        return pa.table([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), *columns], names=["row", "col", *kinds])

    schema = "row int, col int, " + ", ".join(f"`{n}` double" for n in kinds)
    found = stencil(grids, Layout(shape), make, schema)
    return found.select("row", "col", *(F.col(f"`{n}`").cast(kind).alias(n) for n, kind in kinds.items()))


# --- forests -------------------------------------------------------------------------------------
class _Values:
    """An array with the places that hold a value."""

    def __init__(self, array: np.ndarray, there: np.ndarray):
        self.array, self.there = array, there

    @classmethod
    def of(cls, column: pa.ChunkedArray) -> _Values:
        column = column.combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        zero = False if pa.types.is_boolean(column.type) else 0
        return cls(column.fill_null(zero).to_numpy(zero_copy_only=False).copy(), there.copy())

    def arrow(self, kind: pa.DataType, rows=slice(None)) -> pa.Array:
        return pa.array(self.array[rows], kind, mask=~self.there[rows])

    def join(self, at: np.ndarray, other: _Values, which: np.ndarray, how: str) -> None:
        """Folds what ``other`` holds at ``which``, farther along, into the places ``at``."""
        near, far, has, more = self.array[at], other.array[which], self.there[at], other.there[which]
        if how in ("first", "last"):
            take = more & ~has if how == "first" else more
            self.array[at], self.there[at] = np.where(take, far, near), has | more
            return
        out = {"sum": np.add, "max": np.maximum, "either": np.logical_or, "both": np.logical_and}[how](near, far)
        self.array[at], self.there[at] = out, has & more

    def gather(self, into: np.ndarray, rows: np.ndarray, values: _Values, how: str) -> None:
        """Folds values, of ``rows``, from upstream into the places ``into``, several of which may be one place."""
        take = values.array[rows]
        if how == "sum":
            if take.dtype.kind == "f":
                self.array += np.bincount(into, take, len(self.array))
            else:
                np.add.at(self.array, into, take)
        else:
            (np.minimum if how == "min" else np.maximum).at(self.array, into, take)
        np.logical_and.at(self.there, into, values.there[rows])


def _moments(name: str) -> tuple[str, str, str]:
    return tuple(f"{name}_{p}" for p in ("n", "mean", "m2"))


def _merge(own: list[np.ndarray], into: np.ndarray, more: list[np.ndarray]) -> None:
    """Counts, means and squares about the mean of ``more`` merged into the places ``into`` by Chan, Golub and LeVeque's formula."""
    n, mean, m2 = own
    k, far_mean, far_m2 = more
    size = len(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        far_n = np.bincount(into, k, size)
        middle = np.bincount(into, np.where(k > 0, k * far_mean, 0.0), size) / far_n
        apart = far_mean - middle[into]
        spread = np.bincount(into, far_m2 + np.where(k > 0, k * apart * apart, 0.0), size)
        total, step = n + far_n, middle - mean
        both = (n > 0) & (far_n > 0)
        m2 += spread + np.where(both, step * step * n * far_n / total, 0.0)
        mean[:] = np.where(far_n == 0, mean, np.where(n == 0, middle, mean + step * far_n / total))
        n += far_n.astype(n.dtype)


class _Tile:
    """One tile's forest: for each cell the place of the next in the tile, -1 where the path leaves the tile or ends."""

    def __init__(self, cells: pa.Table):
        self.cells = cells
        ids = cells["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        down = cells["down"].combine_chunks()
        self.has = down.is_valid().to_numpy(zero_copy_only=False)
        self.down = down.fill_null(-1).to_numpy()
        self.ids, self.order = ids, order
        self.next = self.find(self.down, self.has)
        exit = np.where(self.next >= 0, self.next, np.arange(len(ids)))
        for _ in range(len(ids).bit_length() + 1):
            on = exit[exit]
            if np.array_equal(on, exit):
                break
            exit = on
        if (self.next[exit] >= 0).any():
            raise CycleError("the flow graph has a cycle")
        self.exit = exit

    def find(self, ids: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
        """Places of ids in the tile, -1 of others."""
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.order), len(self.ids) - 1)
        place = self.order[at]
        hit = self.ids[place] == ids
        return np.where(hit if asked is None else hit & asked, place, -1)

    def downstream(self, how: dict[str, str]) -> dict[str, _Values]:
        out = {c: _Values.of(self.cells[c]) for c in how}
        jump = self.next.copy()
        while (live := np.flatnonzero(jump >= 0)).size:
            far = jump[live]
            for c, v in out.items():
                v.join(live, v, far, how[c])
            jump[live] = jump[far]
        return out

    def upstream(self, how: dict[str, str], moments: tuple[str, ...] = (), add: tuple[np.ndarray, dict[str, _Values]] | None = None) -> dict[str, _Values]:
        out = {c: _Values.of(self.cells[c]) for c in how}
        parts = [_moments(m) for m in moments]
        plain = [c for c in out if not any(c in three for three in parts)]

        def send(into: np.ndarray, rows: np.ndarray, values: dict[str, _Values]) -> None:
            for three in parts:
                _merge([out[c].array for c in three], into, [values[c].array[rows] for c in three])
            for c in plain:
                out[c].gather(into, rows, values[c], how[c])

        if add is not None:
            send(add[0], np.arange(len(add[0])), add[1])
        jump = self.next.copy()
        while (live := np.flatnonzero(jump >= 0)).size:
            send(jump[live], live, out)
            jump[live] = jump[jump[live]]
        return out


def _tile_of(id, ncols: int, size: int):
    wide = -(-ncols // size)
    return F.floor(F.floor(id / ncols) / size).cast("bigint") * wide + F.floor(F.pmod(id, F.lit(ncols)) / size).cast("bigint")


def _edge(ids: np.ndarray, ncols: int, size: int) -> np.ndarray:
    row, col = ids // ncols % size, ids % ncols % size
    return (row == 0) | (row == size - 1) | (col == 0) | (col == size - 1)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _solve(forest: DataFrame | Gathered, ncols: int, how: dict[str, str], size: int, up: bool, moments: tuple[str, ...] = (), anywhere: bool = False) -> DataFrame:
    made = isinstance(forest, Gathered)
    spark = (forest.packs if made else forest).sparkSession
    work = tables.folder(spark)
    if made:
        size = forest.layout.size
    how = how | {c: "moments" for m in moments for c in _moments(m)}
    kinds = {f.name: f.dataType for f in forest.schema}
    names = [c for c in kinds if c != "down"]
    value_types = ", ".join(f"`{c}` array<{kinds[c].simpleString()}>" for c in how)

    def first(cells: pa.Table, enters: np.ndarray | None = None) -> pa.Table:
        tile = cells["__tile"][:1].to_pylist()
        cells = cells.drop_columns(["__tile"])
        types = {c: cells.schema.field(c).type for c in how}
        if not cells.num_rows:
            row = {"tile": pa.array([], pa.int64()), "cells": pa.array([], pa.binary()), **{c: pa.array([], pa.list_(pa.int64())) for c in ("leaves", "to", "enters", "exit")}}
            return pa.table(row | {c: pa.array([], pa.list_(t)) for c, t in types.items()})
        own = _Tile(cells)
        leaves = np.flatnonzero(own.has & (own.next < 0))
        if enters is None:
            edge = np.flatnonzero(_edge(own.ids, ncols, size))
        else:
            edge = own.find(enters)
            edge = edge[edge >= 0]
        found = own.upstream(how, moments) if up else own.downstream(how)
        at = leaves if up else edge  # whose values other tiles need: the totals that leave, or what a path gathers from where it enters
        lists = lambda values: pa.array([values])
        row = {"tile": pa.array(tile, pa.int64()), "cells": pa.array([_packed(cells)], pa.binary()), "leaves": lists(own.ids[leaves]), "to": lists(own.down[leaves]), "enters": lists(own.ids[edge]), "exit": lists(own.ids[own.exit[edge]])}
        row |= {c: pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), v.arrow(types[c], at)) for c, v in found.items()}
        return pa.table(row)

    schema = f"tile bigint, cells binary, leaves array<bigint>, `to` array<bigint>, enters array<bigint>, `exit` array<bigint>, {value_types}"
    if made:
        layout, grids, make = forest.layout, forest.names, forest.make

        def begin(parts: pa.Table) -> pa.Table:
            cells = make(Window(parts, layout, grids))
            return first(cells.append_column("__tile", pa.array(np.full(cells.num_rows, parts["tile"][0].as_py()))))

        solved = forest.packs.groupBy("tile").applyInArrow(begin, schema)
    else:
        placed = forest.withColumn("__tile", _tile_of(F.col("id"), ncols, size))
        if anywhere:  # nodes that other tiles lead to are told so
            goes = placed.select("__tile", "down", _tile_of(F.col("down"), ncols, size).alias("__to")).where("down is not null and __to <> __tile")
            goes = goes.select(F.col("down").alias("id"), F.col("__to").alias("__tile")).distinct()
            placed = placed.withColumn("__enters", F.lit(False)).unionByName(goes.withColumn("__enters", F.lit(True)), allowMissingColumns=True)

        def arrive(cells: pa.Table) -> pa.Table:
            if not anywhere:
                return first(cells)
            told = cells["__enters"].combine_chunks()
            ids, cells = cells.filter(told)["id"].to_numpy(), cells.drop_columns(["__enters"])
            return first(cells.filter(pc.invert(told)), ids)

        solved = placed.groupBy("__tile").applyInArrow(arrive, schema)
    solved = tables.write(solved, f"{work}/tiles")

    zipped = lambda *columns: F.inline(F.arrays_zip(*(F.col(f"`{c}`") for c in columns)))
    values = list(how)
    if up:
        leaving, entering = solved.select(zipped("leaves", "to", *values)), solved.select(zipped("enters", "exit"))
    else:
        leaving, entering = solved.select(zipped("leaves", "to")), solved.select(zipped("enters", "exit", *values))
    # a path that leaves a tile for a cell that is no node ends there
    links = tables.write(leaving.join(entering.withColumnRenamed("enters", "to"), "to"), f"{work}/links")
    if links.isEmpty():
        inflow = None
    else:
        goes_on = links.select(F.col("leaves").alias("exit"), F.lit(True).alias("__on"))
        small = links.join(goes_on, "exit", "left").select(F.col("leaves").alias("id"), F.when(F.col("__on"), F.col("exit")).alias("down"), "to", *values)
        if up:
            whole = D.upstream(small, {c: _COLUMNS[h] for c, h in how.items() if h != "moments"}, moments).select(F.col("to").alias("at"), *values)
        else:
            whole = D.downstream(small, {c: _COLUMNS[h][1] for c, h in how.items()}).select(F.col("id").alias("at"), *values)
        each = whole.groupBy(_tile_of(F.col("at"), ncols, size).alias("tile"))
        inflow = each.agg(F.collect_list(F.struct("at", *(F.struct(F.col(c).alias("v")).alias(c) for c in values))).alias("flow"))

    arrives_any = inflow is not None

    def second(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                cells = pa.ipc.open_stream(batch.column("cells")[k].as_py()).read_all()
                types = {c: cells.schema.field(c).type for c in how}
                own = _Tile(cells)
                flow = batch.column("flow")[k].as_py() if arrives_any else None
                more = {c: _Values.of(pa.chunked_array([pa.array([f[c]["v"] for f in flow], types[c])])) for c in how} if flow else None
                place = own.find(np.array([f["at"] for f in flow], np.int64)) if flow else None
                if up:
                    found = own.upstream(how, moments, (place, more) if flow else None)
                else:
                    found = own.downstream(how)
                    if flow:
                        arrives = np.full(len(own.ids), -1)
                        arrives[place] = np.arange(len(place))
                        arrives = arrives[own.exit]
                        rows = np.flatnonzero(arrives >= 0)
                        for c, v in found.items():
                            v.join(rows, more[c], arrives[rows], how[c])
                columns = [found[c].arrow(types[c]) if c in found else cells[c].combine_chunks() for c in names]
                yield from pa.table(columns, names=names).to_batches(max_chunksize=1 << 16)

    given = solved.select("tile", "cells") if inflow is None else solved.select("tile", "cells").join(inflow, "tile", "left").select("cells", "flow")
    return given.mapInArrow(second, StructType([f for f in forest.schema if f.name != "down"]))


def downstream(forest: DataFrame | Gathered, ncols: int, how: dict[str, str], size: int | None = None, anywhere: bool = False) -> DataFrame:
    """Each column of ``how`` folded over the cell and all cells down its path: 'sum', 'max', 'first', 'last', 'either' or 'both'.

    ``forest(id, down, ..)`` has one row per cell, its id row * ncols + col; ``down`` is a neighbour's id. A path ends where it is null or no
    row's id. The other columns come back as they are. With ``anywhere``, ``down`` is any cell's id.
    """
    return _solve(forest, ncols, how, size or TILE, False, (), anywhere)


def upstream(forest: DataFrame | Gathered, ncols: int, how: dict[str, str], size: int | None = None, moments: tuple[str, ...] = (), anywhere: bool = False) -> DataFrame:
    """Each column of ``how`` folded, by 'sum', 'max' or 'min', over the cell and all cells whose paths lead to it.

    For each m of ``moments`` the columns m_n, m_mean and m_m2 (count, mean, sum of squared distances from it) are merged without cancelling.
    """
    return _solve(forest, ncols, how, size or TILE, True, moments, anywhere)
