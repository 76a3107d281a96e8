"""Terrain made ready for flow: pits and depressions filled, flats given a gradient."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import INF, NAN
from ..plans import tables, tiles
from ..raster import Raster

STEP = 1e-5
GROUP = 16  # tiles of a group, and groups of a group of groups, each way
OUTSIDE = -1  # the node to which all water goes
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _heights(dem: Raster) -> DataFrame:
    """Cells with NoData at minus infinity, where water leaves."""
    return dem.as_nan("z").withColumn("z", F.when(F.isnan("z"), -INF).otherwise(F.col("z").cast("double")))


def _back(dem: Raster, table: DataFrame) -> Raster:
    value = F.when(F.col("z") == -INF, F.lit(NAN)).otherwise(F.col("z"))
    return Raster(table.select("row", "col", value.alias("value")), dem.meta.update(dtype="float64", nodata=NAN))


def fill_pits(dem: Raster) -> Raster:
    """Inner cells lower than all eight neighbours raised to the lowest of them."""
    nrows, ncols = dem.meta.shape

    def raised(window: tiles.Window) -> pa.Table:
        z = window.values("z")
        low = np.full(z.shape, np.nan)
        for dr, dc in _AROUND:
            low = np.fmin(low, window.near(z, dr, dc, NAN))
        z, low, take = window.inner(z), window.inner(low), window.inner(window.there("z"))
        row, col = np.arange(z.shape[0])[:, None] + window.top, np.arange(z.shape[1])[None, :] + window.left
        inner = (row > 0) & (row < nrows - 1) & (col > 0) & (col < ncols - 1)
        z = np.where(inner & (z < low), low, z)
        row, col = window.places(take)
        return pa.table({"row": pa.array(row.astype(np.int32)), "col": pa.array(col.astype(np.int32)), "z": pa.array(z[take])})

    grids = {"z": _heights(dem).withColumnRenamed("z", "value")}
    return _back(dem, tiles.stencil(grids, tiles.Layout(dem.meta.shape, 1), raised, "row int, col int, z double"))


# --- depressions ---------------------------------------------------------------------------------
def _spanning(nodes: int, a: np.ndarray, b: np.ndarray, height: np.ndarray, name: np.ndarray) -> tuple[list, list, list]:
    """Edges between named nodes, -2 being no name, whose greatest height on the way between any two is that of the whole graph."""
    order = np.argsort(height, kind="stable")
    root, names = list(range(nodes)), name.tolist()
    out: tuple[list, list, list] = ([], [], [])
    for s, t, h in zip(a[order].tolist(), b[order].tolist(), height[order].tolist()):
        while root[s] != s:
            root[s] = s = root[root[s]]
        while root[t] != t:
            root[t] = t = root[root[t]]
        if s == t:
            continue
        if names[s] != -2 and names[t] != -2:
            for column, value in zip(out, (names[s], names[t], h)):
                column.append(value)
        root[t] = s
        if names[s] == -2:
            names[s] = names[t]
    return out


def _spill(nodes: int, a: np.ndarray, b: np.ndarray, height: np.ndarray, source: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each node the least height that a way to any of the sources, whose own levels are given, must climb."""
    found = [INF] * nodes
    both, other, cost = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((height, height))
    order = np.argsort(both, kind="stable")
    begin = np.searchsorted(both[order], np.arange(nodes + 1)).tolist()
    other, cost = other[order].tolist(), cost[order].tolist()
    waiting = list(zip(level.tolist(), source.tolist()))
    heapq.heapify(waiting)
    while waiting:
        h, node = heapq.heappop(waiting)
        if h >= found[node]:
            continue
        found[node] = h
        for k in range(begin[node], begin[node + 1]):
            up = cost[k] if cost[k] > h else h
            if up < found[other[k]]:
                heapq.heappush(waiting, (up, other[k]))
    return np.array(found)


class _Basins:
    """A tile's basins: where water comes to rest if it always goes to the lowest neighbour, and the heights between them."""

    def __init__(self, z: np.ndarray, row: int, col: int, shape: tuple[int, int]):
        rows, cols = z.shape
        n = z.size
        index = np.arange(n).reshape(rows, cols)
        padded, ids = np.full((rows + 2, cols + 2), INF), np.full((rows + 2, cols + 2), n)
        padded[1:-1, 1:-1], ids[1:-1, 1:-1] = z, index
        low, to = z.copy(), index.copy()
        for dr, dc in _AROUND:
            near, at = padded[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols], ids[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]
            less = (near < low) | (near == low) & (at < to)  # of equal heights the first, so that a flat is one basin
            low[less], to[less] = near[less], at[less]
        to = to.ravel()
        while not np.array_equal(on := to[to], to):
            to = on
        minima, self.basin = np.unique(to, return_inverse=True)
        self.count = len(minima)
        pairs = []
        for dr, dc in _AROUND[:4]:
            s = index[max(0, -dr) : rows - max(0, dr), max(0, -dc) : cols - max(0, dc)].ravel()
            t = s + dr * cols + dc
            apart = self.basin[s] != self.basin[t]
            s, t = s[apart], t[apart]
            flat = z.ravel()
            pairs.append((np.minimum(self.basin[s], self.basin[t]), np.maximum(self.basin[s], self.basin[t]), np.maximum(flat[s], flat[t])))
        a, b, h = (np.concatenate(c) for c in zip(*pairs))
        order = np.lexsort((h, b, a))
        a, b, h = a[order], b[order], h[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        self.a, self.b, self.h = a[first], b[first], h[first]
        # the lowest cell of each basin by which water leaves the raster
        r, c = np.divmod(np.arange(n), cols)
        gone = (r + row == 0) | (r + row == shape[0] - 1) | (c + col == 0) | (c + col == shape[1] - 1) | (z.ravel() == -INF)
        self.out = np.full(self.count, INF)
        np.minimum.at(self.out, self.basin[gone], z.ravel()[gone])
        self.edge = np.flatnonzero((r == 0) | (r == rows - 1) | (c == 0) | (c == cols - 1))


def _numbers(*arrays) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _read(blob, kind) -> np.ndarray:
    return np.frombuffer(blob, kind)


def fill_depressions(dem: Raster, size: int | None = None, group: int = GROUP) -> Raster:
    """The lowest surface at or above the terrain from which every cell drains to the border or to NoData.

    Tiles are solved by themselves, down to a graph of their edge cells and the heights that ways between these must climb;
    graphs of tiles are joined, and reduced to the edge cells of groups of tiles, and so on, until one task holds what is left. The
    levels then come back the same way. The number of passes grows with the logarithm of the raster's width.
    """
    size = size or tiles.TILE
    nrows, ncols = dem.meta.shape
    spark = dem.cells.sparkSession
    work = tables.folder(spark)
    wide = -(-ncols // size)

    def first(cells: pa.Table) -> pa.Table:
        tile = cells["tile"][0].as_py()
        top, left = tile // wide * size, tile % wide * size
        z = np.full((min(size, nrows - top), min(size, ncols - left)), -INF)
        z[cells["row"].to_numpy() - top, cells["col"].to_numpy() - left] = cells["z"].to_numpy()
        own = _Basins(z, top, left, (nrows, ncols))
        r, c = np.divmod(own.edge, z.shape[1])
        ids, m = (r + top) * ncols + c + left, len(own.edge)
        # nodes: basins, edge cells, outside
        out = np.flatnonzero(own.out < INF)
        a = np.concatenate((own.a, own.count + np.arange(m), out))
        b = np.concatenate((own.b, own.basin[own.edge], np.full(len(out), own.count + m)))
        h = np.concatenate((own.h, z.ravel()[own.edge], own.out[out]))
        names = np.concatenate((np.full(own.count, -2), ids, [OUTSIDE]))
        s, t, up = _spanning(own.count + m + 1, a, b, h, names)
        blobs = _numbers(z, ids.astype(np.int64), z.ravel()[own.edge], np.array(s, np.int64), np.array(t, np.int64), np.array(up, np.float64))
        return pa.table([pa.array([tile], pa.int64()), *blobs], names=["tile", "cells", "ids", "z", "a", "b", "h"])

    tile_of = F.floor(F.col("row") / size).cast("bigint") * wide + F.floor(F.col("col") / size).cast("bigint")
    cells = _heights(dem).withColumn("tile", tile_of)
    solved = tables.write(cells.groupBy("tile").applyInArrow(first, "tile bigint, cells binary, ids binary, z binary, a binary, b binary, h binary"), f"{work}/tiles")

    def graph(parts: pa.Table):
        """Node ids, outside first, with heights; edges within and between the parts."""
        ids = np.concatenate([_read(x, np.int64) for x in parts["ids"].to_pylist()])
        z = np.concatenate([_read(x, np.float64) for x in parts["z"].to_pylist()])
        order = np.argsort(ids)
        ids, z = np.concatenate(([OUTSIDE], ids[order])), np.concatenate(([-INF], z[order]))
        ends = [np.searchsorted(ids, np.concatenate([_read(x, np.int64) for x in parts[c].to_pylist()])) for c in ("a", "b")]
        edges = [(*ends, np.concatenate([_read(x, np.float64) for x in parts["h"].to_pylist()]))]
        for dr, dc in _AROUND[:4]:
            inside = (ids >= 0) & (ids % ncols + dc >= 0) & (ids % ncols + dc < ncols)
            s = np.flatnonzero(inside)
            near = ids[s] + dr * ncols + dc
            t = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            there = ids[t] == near
            edges.append((s[there], t[there], np.maximum(z[s[there]], z[t[there]])))
        return ids, z, *(np.concatenate(c) for c in zip(*edges))

    def reduce(span: int):
        def run(parts: pa.Table) -> pa.Table:
            ids, z, a, b, h = graph(parts)
            row, col = ids // ncols, ids % ncols
            edge = (ids >= 0) & ((row % span == 0) | (row % span == span - 1) | (row == nrows - 1) | (col % span == 0) | (col % span == span - 1) | (col == ncols - 1))
            s, t, up = _spanning(len(ids), a, b, h, np.where(edge | (ids == OUTSIDE), ids, -2))
            blobs = _numbers(ids[edge], z[edge], np.array(s, np.int64), np.array(t, np.int64), np.array(up, np.float64))
            return pa.table([parts["group"].slice(0, 1), *blobs], names=["tile", "ids", "z", "a", "b", "h"])

        return run

    def descend(parts: pa.Table) -> pa.Table:
        """Levels of all nodes of a group, for each of its parts, from those of its own edge cells."""
        ids, _, a, b, h = graph(parts)
        given, level = (_read(parts[c][0].as_py() or b"", kind) for c, kind in (("given", np.int64), ("level", np.float64)))
        source = np.concatenate(([0], np.searchsorted(ids, given)))
        found = _spill(len(ids), a, b, h, source, np.concatenate(([-INF], level)))
        own = [_read(x, np.int64) for x in parts["ids"].to_pylist()]
        blobs = [pa.array([found[np.searchsorted(ids, x)].tobytes() for x in own], pa.binary())]
        return pa.table([parts["tile"], parts["ids"], *blobs], names=["tile", "given", "level"])

    # up: each level's parts, with the number of the group that each is in
    parts, span, across, levels = solved.select("tile", "ids", "z", "a", "b", "h"), size, wide, []
    while True:
        over = -(-across // group)
        group_of = F.floor(F.floor(F.col("tile") / across) / group).cast("bigint") * over + F.floor(F.pmod("tile", F.lit(across)) / group).cast("bigint")
        levels.append(parts.withColumn("group", group_of))
        span, across = span * group, over
        if span >= max(nrows, ncols):
            break
        parts = tables.write(levels[-1].groupBy("group").applyInArrow(reduce(span), "tile bigint, ids binary, z binary, a binary, b binary, h binary"), f"{work}/groups{len(levels)}")
    # and down
    known = None
    for k, level in reversed(list(enumerate(levels))):
        if known is None:
            level = level.withColumns({"given": F.lit(None).cast("binary"), "level": F.lit(None).cast("binary")})
        else:
            level = level.join(known.withColumnRenamed("tile", "group"), "group")
        known = tables.write(level.groupBy("group").applyInArrow(descend, "tile bigint, given binary, level binary"), f"{work}/levels{k}")

    def second(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = batch.column("tile")[k].as_py()
                top, left = tile // wide * size, tile % wide * size
                z = _read(batch.column("cells")[k].as_py(), np.float64).reshape(min(size, nrows - top), min(size, ncols - left))
                own = _Basins(z, top, left, (nrows, ncols))
                out = np.flatnonzero(own.out < INF)
                source = np.concatenate((out, own.basin[own.edge]))
                level = np.concatenate((own.out[out], _read(batch.column("level")[k].as_py(), np.float64)))
                filled = np.maximum(z.ravel(), _spill(own.count, own.a, own.b, own.h, source, level)[own.basin])
                r, c = np.divmod(np.arange(z.size), z.shape[1])
                yield from pa.table([pa.array((r + top).astype(np.int32)), pa.array((c + left).astype(np.int32)), pa.array(filled)], names=["row", "col", "z"]).to_batches(max_chunksize=1 << 16)

    found = solved.select("tile", "cells").join(known.select("tile", "level"), "tile").mapInArrow(second, "row int, col int, z double")
    return _back(dem, found)


# --- flats ---------------------------------------------------------------------------------------
_NONE = np.int64(1 << 62)


class _Flats:
    """A tile with two cells of its neighbours around it: which cells are stuck, and what the neighbours know."""

    def __init__(self, z: np.ndarray, row: int, col: int, shape: tuple[int, int]):
        """``z`` with the ring, NaN outside the raster; ``row`` and ``col`` are those of the ring's corner."""
        self.z, self.width = z.ravel(), z.shape[1]
        rows, cols = z.shape
        r, c = np.divmod(np.arange(z.size), cols)
        self.id = (r + row) * shape[1] + c + col
        whole = (r > 0) & (r < rows - 1) & (c > 0) & (c < cols - 1)  # whose neighbours are all here
        at = np.flatnonzero(whole)
        lower, higher = np.zeros(z.size, bool), np.zeros(z.size, bool)
        steps = [dr * cols + dc for dr, dc in _AROUND]
        for step in steps:
            lower[at] |= self.z[at + step] < self.z[at]
            higher[at] |= self.z[at + step] > self.z[at]
        border = (r + row == 0) | (r + row == shape[0] - 1) | (c + col == 0) | (c + col == shape[1] - 1)
        there = ~np.isnan(self.z)
        self.stuck = there & whole & ~lower & ~border & (self.z != -INF)
        drains = there & whole & ~self.stuck
        outlet = np.zeros(z.size, bool)
        for step in steps:
            outlet[at] |= self.stuck[at + step] & drains[at] & (self.z[at + step] == self.z[at])
        self.steps, self.whole = np.array(steps), whole
        # cells two rings out don't know their neighbours; what they are comes from the tile that owns them
        self.own = (r > 1) & (r < rows - 2) & (c > 1) & (c < cols - 2)
        self.ring = whole & ~self.own
        self.flat = [self.stuck | outlet, self.stuck, self.stuck]
        self.values = [np.where(outlet, 1, _NONE), np.where(self.stuck & higher, 1, _NONE), np.where(self.stuck, self.id, _NONE)]

    def settle(self) -> None:
        """Least steps to an outlet, least steps from higher terrain, and the least id that a stuck cell reaches."""
        for flat, value, more in zip(self.flat, self.values, (1, 1, 0)):
            front = np.flatnonzero(flat & (value < _NONE) & self.whole)
            while len(front):
                changed = []
                for step in self.steps:
                    to = front + step
                    way = flat[to] & (self.z[to] == self.z[front]) & self.own[to] & (value[front] + more < value[to])
                    np.minimum.at(value, to[way], value[front[way]] + more)
                    changed.append(to[way])
                front = np.unique(np.concatenate(changed))


def resolve_flats(dem: Raster, by: float = STEP, size: int | None = None) -> Raster:
    """Flats sloped towards lower and away from higher terrain, after Barnes, Lehman and Mulla (2014).

    A cell without a lower neighbour rises by ``by`` times twice its steps to the flat's outlet plus, within the flat, the steps
    by which it is nearer to higher terrain than the farthest one. Each round settles tiles by themselves and hands what changed on
    their edges to their neighbours, so rounds grow with the number of tiles that a flat winds through, not with its cells.
    """
    size = size or tiles.TILE
    nrows, ncols = dem.meta.shape
    spark = dem.cells.sparkSession
    work = tables.folder(spark)
    wide, high = -(-ncols // size), -(-nrows // size)
    near = lambda at, n: F.array_distinct(F.filter(F.transform(F.array(*(F.lit(k) for k in (-2, 0, 2))), lambda k: F.floor((F.col(at) + k) / size).cast("bigint")), lambda t: (t >= 0) & (t < n)))
    sent = _heights(dem).withColumn("tr", F.explode(near("row", high))).withColumn("tc", F.explode(near("col", wide)))

    def corner(tile: int) -> tuple[int, int, tuple[int, int]]:
        top, left = tile // wide * size, tile % wide * size
        return top - 2, left - 2, (min(size, nrows - top) + 4, min(size, ncols - left) + 4)

    def dense(cells: pa.Table) -> pa.Table:
        tile = cells["tile"][0].as_py()
        row, col, shape = corner(tile)
        z = np.full(shape, np.nan)
        z[cells["row"].to_numpy() - row, cells["col"].to_numpy() - col] = cells["z"].to_numpy()
        return pa.table([pa.array([tile], pa.int64()), *_numbers(z)], names=["tile", "z"])

    sent = sent.select("row", "col", "z", (F.col("tr") * wide + F.col("tc")).alias("tile"))
    blobs = tables.write(sent.groupBy("tile").applyInArrow(dense, "tile bigint, z binary"), f"{work}/tiles")
    fields = ("toward", "away", "name")

    def solve(last: bool):
        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    tile = batch.column("tile")[k].as_py()
                    row, col, shape = corner(tile)
                    own = _Flats(_read(batch.column("z")[k].as_py(), np.float64).reshape(shape), row, col, (nrows, ncols))
                    for known in batch.column("known")[k].as_py() or ():
                        at = (known["id"] // ncols - row) * shape[1] + known["id"] % ncols - col
                        for value, field in zip(own.values, fields):
                            value[at] = min(int(value[at]), known[field])
                    # an outlet of a neighbour's flat on the ring is known there; one of ours is known here
                    own.settle()
                    if last:
                        at = np.flatnonzero(own.own)
                        columns = [own.id[at] // ncols, own.id[at] % ncols]
                        out = [pa.array(c.astype(np.int32)) for c in columns] + [pa.array(own.z[at]), pa.array(own.stuck[at])]
                        out += [pa.array(v[at], mask=v[at] == _NONE) for v in own.values]
                        yield from pa.table(out, names=["row", "col", "z", "stuck", *fields]).to_batches(max_chunksize=1 << 16)
                        continue
                    r, c = np.divmod(np.flatnonzero(own.own), shape[1])
                    rim = (r == 2) | (r == shape[0] - 3) | (c == 2) | (c == shape[1] - 3)
                    at = np.flatnonzero(own.own)[rim]
                    at = at[np.min([v[at] for v in own.values], axis=0) < _NONE]
                    yield pa.RecordBatch.from_arrays([pa.array(own.id[at]), *(pa.array(v[at]) for v in own.values)], names=["id", *fields])

        return run

    nothing = "array<struct<id:bigint,toward:bigint,away:bigint,name:bigint>>"
    known, state, turn = None, None, 0
    while True:
        given = blobs.withColumn("known", F.lit(None).cast(nothing)) if known is None else blobs.join(known, "tile", "left")
        edge = tables.write(given.mapInArrow(solve(False), "id bigint, toward bigint, away bigint, name bigint"), f"{work}/edge{turn}")
        now = edge.agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in fields)).first()
        if now == state or now["n"] == 0 or wide * high == 1:  # values only fall
            break
        state, turn = now, turn + 1
        seen = edge.withColumn("row", F.floor(F.col("id") / ncols)).withColumn("col", F.pmod("id", F.lit(ncols)))
        seen = seen.withColumn("tr", F.explode(near("row", high))).withColumn("tc", F.explode(near("col", wide)))
        known = tables.write(seen.groupBy((F.col("tr") * wide + F.col("tc")).alias("tile")).agg(F.collect_list(F.struct("id", *fields)).alias("known")), f"{work}/known{turn}")
    given = blobs.withColumn("known", F.lit(None).cast(nothing)) if known is None else blobs.join(known, "tile", "left")
    table = tables.write(given.mapInArrow(solve(True), "row int, col int, z double, stuck boolean, toward bigint, away bigint, name bigint"), f"{work}/flats")
    tall = table.where("stuck").groupBy("name").agg(F.max(F.coalesce("away", F.lit(0))).alias("h"))
    # the others, most of the cells, have no name by which to join
    flats, rest = table.where("stuck").join(tall, "name"), table.where("not stuck").withColumn("h", F.lit(0).cast("long"))
    total = flats.unionByName(rest)
    up = F.when(F.col("stuck"), F.col("h") - F.coalesce("away", F.lit(0))).otherwise(0)
    return _back(dem, total.select("row", "col", (F.col("z") + by * (2 * F.coalesce("toward", F.lit(0)) + up)).alias("z")))


def condition(dem: Raster, pits: bool = True, depressions: bool = True, flats: bool = True) -> Raster:
    """The steps asked for, in order."""
    if not (pits or depressions or flats):
        raise ValueError("at least one step is needed")
    for wanted, step in ((pits, fill_pits), (depressions, fill_depressions), (flats, resolve_flats)):
        dem = step(dem) if wanted else dem
    return dem
