"""Near-duplicate embeddings: a forest of random-projection trees groups most of them, all pairs between its groups are searched exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, integer, remove, shared_dir, written
from .simhash import _forest

THRESHOLD = 0.95
TREES = 6
LEAF = 256
SPILL = 0.05
CELL, MAX_CELLS, SAMPLE = 16_384, 1024, 128  # vectors of a cell at the end of the upper levels; such cells at most; sampled vectors a cell
BLOCKS, VALUES = 8, 1 << 23  # blocks of the exact search at most, unless one would hold more than so many parts of vectors
GROUP, TILE = 1024, 1024  # a larger group is spread over the blocks; groups, or vectors, multiplied at once
DEAR, EXPANDED = 20, 1 << 20  # a pair looked up costs about so many multiplied ones; pairs looked up for a tile at most
_FLUSH = 2_000_000


def _by_width(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors (float64) of the usable rows of a list column, width by width; others come in none."""
    column = K.as_array(column)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    for width in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == width)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy().reshape(-1, width)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(flat).max(1)
            fine = np.isfinite(top) & (top > 0)
            flat = flat[fine] / top[fine, None]  # so that squares neither overflow nor vanish
        yield rows[fine], flat / np.sqrt((flat**2).sum(1))[:, None]


def _hashes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each vector, as single-precision numbers."""
    words = np.ascontiguousarray(unit.astype(np.float32) + 0.0).view(np.uint32).astype(np.uint64)  # + 0.0: no minus zero
    out = []
    for seed in (1, 2):
        h = np.full(len(words), words.shape[1] * 4 + seed, np.uint64)
        for column in words.T:
            h = K.mix(h ^ column * np.uint64(0x9E3779B97F4A7C15 if seed == 1 else 0xC2B2AE3D27D4EB4F))
        out.append(h.view(np.int64))
    return out[0], out[1]


def _binaries(rows: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    n, size = rows.shape
    at = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _quantised(unit: np.ndarray, kind: type = np.int16) -> np.ndarray:
    """Rows of 8 bytes and one or two for each part: the step, the length of what rounding loses, the rounded parts."""
    most = np.iinfo(kind).max
    step = (np.abs(unit).max(1) / most).astype(np.float32)
    whole = np.rint(unit / step[:, None]).clip(-most, most).astype(kind)
    lost = np.sqrt(((unit - whole * step[:, None].astype(np.float64)) ** 2).sum(1)) * (1 + 1e-6) + 1e-7
    return np.concatenate((step[:, None].view(np.uint8), lost.astype(np.float32)[:, None].view(np.uint8), whole.view(np.uint8)), axis=1)


def _names(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's rounded vector; vectors that are rounded alike have one name."""
    h = np.full(len(raw), raw.shape[1], np.uint64)
    for column in np.delete(raw, slice(4, 8), axis=1).T:
        h = K.mix(h ^ column.astype(np.uint64))
    return h.view(np.int64)


def _restored(blobs, kind: type = np.int16) -> tuple[np.ndarray, np.ndarray]:
    """Vectors near the unit vectors, and how far off they may be, of blobs of one length."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    step, lost = (np.ascontiguousarray(raw[:, a : a + 4]).view(np.float32) for a in (0, 4))
    return np.ascontiguousarray(raw[:, 8:]).view(kind) * step, lost[:, 0]


def _coarse(x: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """The rows of one byte a part for vectors that are themselves ``lost`` off."""
    raw = _quantised(x.astype(np.float64), np.int8)
    more = np.ascontiguousarray(raw[:, 4:8]).view(np.float32) + lost[:, None] + np.float32(1e-7)
    raw[:, 4:8] = more.view(np.uint8)
    return raw


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = K.as_array(batch.column("vec_id"))
        for rows, unit in _by_width(batch.column("v")):
            if len(rows):
                h0, h1 = _hashes(unit)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(h0), pa.array(h1), pa.array(np.full(len(rows), unit.shape[1], np.int32)), _binaries(_quantised(unit))], names=["node", "h0", "h1", "width", "q"])


def _direction(seed: int, tree: int, level: int, width: int) -> np.ndarray:
    return np.random.default_rng((seed, tree, level, width)).standard_normal(width).astype(np.float32)


def _cuts(p: np.ndarray, spill: float) -> tuple[float, float]:
    """Where the overlap about the median begins and ends."""
    low, high = np.quantile(p, (0.5 - spill, 0.5 + spill), method="nearest")
    return float(low), float(high)


def _upper(x: np.ndarray, levels: int, tree: int, seed: int, spill: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each level's cuts of a tree, by cell, as medians of the sample ``x``; a cell without a sample isn't split.

    Where a cut falls decides which pairs the forest finds, not which are found: the exact search takes the rest.
    """
    out, cells = [], [np.arange(len(x))]
    for level in range(levels):
        p = x @ _direction(seed, tree, level, x.shape[1])
        low, high, below = np.full(len(cells), np.inf, np.float32), np.full(len(cells), np.inf, np.float32), []
        for k, rows in enumerate(cells):
            if len(rows) > 1:
                low[k], high[k] = _cuts(p[rows], spill)
            below += [rows[p[rows] <= high[k]], rows[p[rows] >= low[k]]]
        out.append((low, high))
        cells = below
    return out


def _assigned(x: np.ndarray, cuts: list, tree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each vector in the cells at the end of a tree's upper levels; in several cells if it lies in an overlap."""
    rows, cells = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level, (low, high) in enumerate(cuts):
        p = (x @ _direction(seed, tree, level, x.shape[1]))[rows]
        left, right = p <= high[cells], p >= low[cells]
        rows, cells = np.concatenate((rows[left], rows[right])), np.concatenate((cells[left] * 2, cells[right] * 2 + 1))
    return rows, cells


def _leaves(x: np.ndarray, level: int, tree: int, seed: int, leaf: int, spill: float) -> Iterator[np.ndarray]:
    """The leaves under one cell: rows split at the median of a random projection while they are more than ``leaf``."""
    waiting = [(np.arange(len(x)), level)]
    directions: dict[int, np.ndarray] = {}
    while waiting:
        rows, level = waiting.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        if level not in directions:
            directions[level] = _direction(seed, tree, level, x.shape[1])
        p = x[rows] @ directions[level]
        low, high = _cuts(p, spill)
        left, right = rows[p <= high], rows[p >= low]
        if max(len(left), len(right)) > 0.9 * len(rows):  # ties are cut by their order, so that every leaf is small
            order = np.argsort(p, kind="stable")
            half, more = len(rows) // 2, min(max(1, int(spill * len(rows))), len(rows) // 2 - 1)
            left, right = rows[order[: half + more]], rows[order[half - more :]]
        waiting += [(left, level + 1), (right, level + 1)]


def _pairs(x: np.ndarray, lost: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a leaf that surely reach the threshold.

    A cosine differs from the product of the rounded vectors by at most what rounding lost of either, and their product.
    """
    own = x[rows]
    a, b = np.nonzero(np.triu(own @ own.T >= threshold, 1))
    dot = np.einsum("ij,ij->i", own[a], own[b])
    a, b = rows[a], rows[b]
    sure = dot >= threshold + lost[a] + lost[b] + lost[a] * lost[b] + _float_error(x.shape[1])
    return a[sure], b[sure]


def _float_error(width: int) -> float:
    """More than a product of two vectors of about unit length can be off in single precision."""
    return 1e-6 + width * 1.2e-7


class _Forest:
    """What all tasks know of the trees: their number and the cuts of their upper levels, by width."""

    def __init__(self, trees: int, cuts: dict, seed: int, threshold: float, leaf: int, spill: float):
        self.trees, self.cuts, self.seed, self.threshold, self.leaf, self.spill = trees, cuts, seed, threshold, leaf, spill

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, blobs, node = batch.column("width").to_numpy(), K.as_array(batch.column("q")), K.as_array(batch.column("node"))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x, lost = _restored(blobs.take(pa.array(at)).to_pylist())
                coarse = _binaries(_coarse(x, lost))
                for tree in range(self.trees):
                    rows, cells = _assigned(x, self.cuts.get((int(width), tree), []), tree, self.seed)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), pa.array(np.full(n, width, np.int32)), pa.array(cells.astype(np.int32)), node.take(pa.array(at[rows])), coarse.take(pa.array(rows))], names=["tree", "width", "cell", "node", "q"])

    def compare(self, table: pa.Table) -> pa.Table:
        """Sure edges between one cell's vectors, a star for each component."""
        table = table.combine_chunks()
        tree, width = table["tree"][0].as_py(), table["width"][0].as_py()
        node, blobs = table["node"].to_numpy(), table["q"].to_pylist()
        # vectors that are rounded alike are one here, which may be as far off as any of them
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        _, first, which = np.unique(_names(raw), return_index=True, return_inverse=True)
        x, _ = _restored([blobs[k] for k in first], np.int8)
        lost = np.zeros(len(first), np.float32)
        np.maximum.at(lost, which, np.ascontiguousarray(raw[:, 4:8]).view(np.float32)[:, 0])
        own = np.flatnonzero(first[which] != np.arange(len(node)))
        sure = (x[which[own]] ** 2).sum(1) - 2 * lost[which[own]] - lost[which[own]] ** 2 - _float_error(width) >= self.threshold
        a, b, held = [own[sure]], [first[which[own[sure]]]], 0
        for rows in _leaves(x, len(self.cuts.get((width, tree), [])), tree, self.seed, self.leaf, self.spill):
            if len(rows) > 1:
                s, t = _pairs(x, lost, rows, self.threshold)
                a.append(first[s])
                b.append(first[t])
                held += len(s)
                if held > _FLUSH:
                    s, t = _forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [s], [t], 0
        s, t = _forest(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": node[s], "b": node[t]})


class _Balls:
    """The vectors of a block, by group, with a centre of each group and the angle within which all its vectors lie; by that angle."""

    def __init__(self, x: np.ndarray, lost: np.ndarray, group: np.ndarray, rows: np.ndarray):
        error = _float_error(x.shape[1])
        rows = rows[np.argsort(group[rows], kind="stable")]
        start = np.flatnonzero(np.concatenate(([True], group[rows][1:] != group[rows][:-1])))
        size = np.diff(np.append(start, len(rows)))
        own = x[rows]
        centre = np.add.reduceat(own, start, axis=0)
        length = np.sqrt((centre**2).sum(1))
        short = length < 1e-3 * size  # vectors that cancel have no mean direction
        centre[short] = own[start[short]]
        centre /= np.sqrt((centre**2).sum(1))[:, None]
        off = np.einsum("ij,ij->i", own, np.repeat(centre, size, axis=0)) / np.sqrt((own**2).sum(1))
        angle = np.where(np.repeat(size, size) == 1, 0, np.arccos(np.clip(off - error, -1, 1))) + 1.1 * lost[rows] + 1e-6
        radius = np.maximum.reduceat(angle, start)
        order = np.argsort(radius, kind="stable")
        self.size, self.radius, self.centre, self.group = size[order], radius[order], centre[order], group[rows][start][order]
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.rows = rows[np.repeat(start[order] - self.start[:-1], self.size) + np.arange(len(rows))]


class _Rest:
    """The exact search: all pairs of vectors of different groups, in blocks."""

    def __init__(self, threshold: float, blocks: dict[int, int], tile: int = TILE):
        self.threshold, self.blocks, self.tile = threshold, blocks, tile

    def compare(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two blocks, or within one. Kinds: 0 groups that are one, 1 vectors to be verified.

        Groups are compared by their balls first: two hold no link if their centres are further apart than the threshold's angle and
        both radii. The vectors of the others are looked up pair by pair, or those of the whole tile are multiplied if that is less work.
        """
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        names, group = np.unique(table["root"].to_numpy(), return_inverse=True)
        x, lost = _restored(table["q"].to_pylist())
        error, angle = _float_error(x.shape[1]), float(np.arccos(np.clip(self.threshold - 1e-9, -1, 1)))
        label = np.arange(len(names))  # groups that have turned out to be one
        doubtful: list[tuple[np.ndarray, np.ndarray]] = []
        sides = [_Balls(x, lost, group, np.flatnonzero(block == k)) for k in np.unique(block)]
        if table["i"][0].as_py() != table["j"][0].as_py() and len(sides) < 2:
            return  # one of the blocks is empty

        def batch(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        def judge(a, b):
            for k in range(0, len(a), 1 << 16):
                s, t = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                apart = label[group[s]] != label[group[t]]
                s, t = s[apart], t[apart]
                dot = np.einsum("ij,ij->i", x[s], x[t])
                off = lost[s] + lost[t] + lost[s] * lost[t] + error
                sure = dot >= self.threshold + off
                if sure.any():
                    one, root = _forest(label[group[s[sure]]], label[group[t[sure]]])
                    to = np.arange(len(names))
                    to[one] = root
                    label[:] = to[label]
                open_ = ~sure & (dot >= self.threshold - off)
                if open_.any():
                    doubtful.append((s[open_], t[open_]))

        def still():
            s, t = (np.concatenate(c) for c in zip(*doubtful))
            apart = label[group[s]] != label[group[t]]
            doubtful[:] = [(s[apart], t[apart])]
            return node[s[apart]], node[t[apart]]

        for one, other, s, t in self._tiles(sides):
            p, q = slice(s, s + self.tile), slice(t, t + self.tile)
            radii = one.radius[p], other.radius[q]
            g = one.centre[p] @ other.centre[q].T
            low = np.cos(np.minimum(angle + radii[0] + radii[1].max(), np.pi)) - error
            hit = np.flatnonzero(g.max(1) >= low)
            a, b = np.nonzero(g[hit] >= low[hit, None])
            a = hit[a]
            near = (g[a, b] >= np.cos(np.minimum(angle + radii[0][a] + radii[1][b], np.pi)) - error) & (label[one.group[p][a]] != label[other.group[q][b]])
            if one is other and s == t:
                near &= a < b
            a, b = a[near] + s, b[near] + t
            left, right = (side.rows[side.start[k] : side.start[min(k + self.tile, len(side.size))]] for side, k in ((one, s), (other, t)))
            pairs = one.size[a] * other.size[b]
            if pairs.sum() <= min(len(left) * len(right) // DEAR, EXPANDED):
                each = np.repeat(np.arange(len(a)), pairs)
                k = np.arange(len(each)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                width = other.size[b][each]
                judge(one.rows[one.start[a][each] + k // width], other.rows[other.start[b][each] + k % width])
            else:
                for u in range(0, len(left), self.tile):
                    for v in range(u if one is other and s == t else 0, len(right), self.tile):
                        a, b = left[u : u + self.tile], right[v : v + self.tile]
                        least = self.threshold - float(lost[a].max()) - float(lost[b].max()) - float(lost[a].max() * lost[b].max()) - error
                        m, n = np.nonzero((x[a] @ x[b].T >= least) & (label[group[a]][:, None] != label[group[b]]))
                        judge(a[m], b[n])
                        if sum(len(c) for c, _ in doubtful) > _FLUSH and len(still()[0]) > _FLUSH // 2:
                            yield batch(1, *still())
                            doubtful.clear()
            if sum(len(c) for c, _ in doubtful) > _FLUSH and len(still()[0]) > _FLUSH // 2:
                yield batch(1, *still())
                doubtful.clear()
        merged = np.flatnonzero(label != np.arange(len(names)))
        yield batch(0, names[merged], names[label[merged]])
        if doubtful:
            yield batch(1, *still())

    def _tiles(self, sides: list[_Balls]) -> Iterator[tuple[_Balls, _Balls, int, int]]:
        one, other = sides[0], sides[-1]
        for s in range(0, len(one.size), self.tile):
            for t in range(s if one is other else 0, len(other.size), self.tile):
                yield one, other, s, t

    def links(self, nodes: DataFrame, roots: DataFrame) -> DataFrame:
        """``(kind, a, b)`` of all pairs of blocks of ``nodes(node, width, q)`` whose groups are ``roots(node, root)``."""
        large = roots.groupBy("root").count().where(F.col("count") > GROUP).select(F.col("root").alias("large"))
        grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        grouped = grouped.join(large, F.col("root") == F.col("large"), "left")
        many = F.coalesce(*(F.when(F.col("width") == w, n) for w, n in self.blocks.items() if n > 1), F.lit(1))
        block = F.pmod(F.xxhash64(F.when(F.col("large").isNull(), F.col("root")).otherwise(F.col("node"))), F.col("many")).cast("int")
        placed = grouped.withColumn("many", many).withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        placed = placed.select("width", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "root", "q")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from self.compare(batches)

        return placed.groupBy("width", "i", "j").applyInArrow(compare, "kind int, a bigint, b bigint")


def _verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs(a, b)`` whose vectors reach the threshold exactly."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ({r: u for rows_, unit in _by_width(batch.column(c)) for r, u in zip(rows_, unit)} for c in ("va", "vb"))
            good = np.array([k in left and k in right and len(left[k]) == len(right[k]) and float(left[k] @ right[k]) >= threshold - 1e-9 for k in range(batch.num_rows)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    ends = [rows.select(F.col("vec_id").alias(c), F.col("v").alias(f"v{c}")) for c in ("a", "b")]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "va", "vb").mapInArrow(check, "a bigint, b bigint").distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 5, cell: int = CELL) -> DataFrame:
    """``(vec_id, group_id, is_kept)``: one row per vector with an id, group_id the least id of its group.

    A group is a connected component of the relation "cosine at least ``threshold``"; no link is lost. A forest of ``trees`` finds most
    links: each tree splits its nodes at the median of a random projection as long as they hold more than ``leaf`` vectors; the ``spill``
    share on either side of the median goes both ways. The upper levels, down to cells of about ``cell`` vectors or MAX_CELLS cells, are
    cut at the medians of SAMPLE vectors a cell, which the driver holds, so that all vectors find their cells in one pass and are
    shuffled once; a cell is split further in its own task. All pairs within a leaf are compared, as bytes; what rounding leaves in doubt
    is left to the second step. That step is exact and finds what the forest missed, so trees and cuts change the cost only: all pairs of
    blocks of about ``cell`` vectors (larger ones when there would be more than BLOCKS) are searched for links between different groups.
    Groups whose centres are too far apart for any link are passed over. Vectors travel as two bytes a part there; a pair that rounding
    leaves in doubt is verified from the vectors themselves. Equal vectors are one node. The second step's time grows with the square
    of the number of groups at least, and its shuffle with the vectors times the blocks.

    Vectors of each length are compared among themselves. A null or empty vector, or one with null, NaN or infinite parts or only
    zeros, is in a group of its own. Ids are integers; null ids, and values that are none, are left out; repeated ids are one document
    whose groups join. Empty input gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    work = shared_dir(spark)
    rows = vectors.select(integer("vec_id").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    units = written(rows.mapInArrow(_units, "node bigint, h0 bigint, h1 bigint, width int, q binary"), f"{work}/units")
    # of equal vectors the least id is the node; only ids and hashes are shuffled for it
    least = units.groupBy("h0", "h1").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("h0", "h1", "least")
    least = written(least, f"{work}/least")
    copies = written(units.select("node", "h0", "h1").join(least, ["h0", "h1"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), f"{work}/copies")
    if least.isEmpty():
        nodes = units.select("node", "width", "q")
    else:
        joined = units.join(least, ["h0", "h1"], "left")
        once = joined.where("node = least").groupBy("node", "h0", "h1").agg(F.first("width").alias("width"), F.first("q").alias("q"))
        nodes = written(joined.where("least is null").select("node", "width", "q").unionByName(once.select("node", "width", "q")), f"{work}/nodes")
    sizes = {r["width"]: r["count"] for r in nodes.groupBy("width").count().collect()}
    total = sum(sizes.values())
    edges = copies
    if total > 1:
        levels = {w: max(0, math.ceil(math.log2(min(MAX_CELLS, c / cell)))) if c > cell else 0 for w, c in sizes.items()}
        sample: dict[int, np.ndarray] = {}
        if any(levels.values()):
            share = {w: min(1.0, (SAMPLE << k) / sizes[w]) for w, k in levels.items() if k}
            draw = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1_000_000)) < F.coalesce(*(F.when(F.col("width") == w, int(s * 1_000_000)) for w, s in share.items()), F.lit(0))
            got = nodes.where(draw).select("width", "q").toArrow()
            of = got["width"].to_numpy()
            blobs = np.array(got["q"].to_pylist(), object)
            sample = {w: _restored(blobs[of == w].tolist())[0] for w in share if (of == w).any()}
        cuts = {(w, t): _upper(x, levels[w], t, seed, spill) for w, x in sample.items() for t in range(trees)}
        forest = _Forest(trees, cuts, seed, threshold, leaf, spill)
        placed = nodes.mapInArrow(forest.assign, "tree int, width int, cell int, node bigint, q binary")
        found = written(placed.groupBy("tree", "width", "cell").applyInArrow(lambda table: forest.compare(table), "a bigint, b bigint"), f"{work}/found")
        edges = edges.unionByName(found)
    roots = written(components(edges, f"{work}/cc"), f"{work}/roots")
    if total > 1:
        blocks = {w: max(min(math.ceil(c / cell), BLOCKS), math.ceil(c * w / VALUES)) for w, c in sizes.items()}
        rest = written(_Rest(threshold, blocks).links(nodes, roots), f"{work}/rest")
        if not rest.isEmpty():
            more = rest.where("kind = 0").select("a", "b").unionByName(_verified(rest.where("kind = 1").select("a", "b"), rows, threshold))
            stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = written(components(stars.unionByName(written(more, f"{work}/more")), f"{work}/cc"), f"{work}/all")
    groups = rows.select("vec_id").distinct().join(roots, F.col("vec_id") == F.col("node"), "left")
    groups = written(groups.groupBy("vec_id").agg(F.min(F.coalesce("root", "vec_id")).alias("group_id")), f"{work}/groups")
    for name in ("units", "least", "nodes", "copies", "found", "rest", "more"):
        remove(spark, f"{work}/{name}")
    return groups.select("vec_id", "group_id", (F.col("vec_id") == F.col("group_id")).alias("is_kept"))
