"""SimHash near-duplicates by random bit sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, integer, remove, shared_dir, written

BITS = 128
RADIUS = 22
TABLES = 32
SAMPLED = 16
CAP = 512
MORE_BITS, MORE_TABLES, LEVELS = 4, 3, 3
BLOCK = 4096  # rows of a bucket searched exactly in one piece


def fingerprints(column, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the SimHash of every text, and whether it has words.

    The features are the distinct words of the whole text, in lower case, each of weight one, so
    words that every document repeats weigh little. A text without words gets the hash of its
    bytes, so that it meets exact copies only.
    """
    data, offsets = K.text_buffer(column)
    n = len(offsets) - 1
    out = np.zeros((n, 2), np.uint64)
    worded = np.zeros(n, bool)
    for i, j in K.spans(offsets):
        hashes, owner = K.word_hashes(data, offsets[i : j + 1])
        # distinct words by document: the owner in the high bits, 44 bits of hash below
        key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        owner = (key >> np.uint64(44)).astype(np.int64)
        first = K.mix(key & np.uint64((1 << 44) - 1) ^ np.uint64(seed))
        second = K.mix(first)
        sizes = np.bincount(owner, minlength=j - i)
        votes = np.zeros((j - i, BITS), np.int64)
        for a in range(0, len(key), 1 << 16):
            b = min(a + (1 << 16), len(key))
            bits = np.unpackbits(np.stack((first[a:b], second[a:b]), 1).view(np.uint8), axis=1)
            at = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
            votes[owner[a:b][at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[i:j] = np.packbits(votes * 2 > sizes[:, None], axis=1).view(np.uint64)
        worded[i:j] = sizes > 0
    for i in np.flatnonzero(~worded):
        raw = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes().ljust((int(offsets[i + 1] - offsets[i]) // 8 + 1) * 8, b"\0"), np.uint64)
        h = K.mix(np.array([len(raw)], np.uint64))
        for at in range(0, len(raw), 1 << 16):
            part = K.mix(raw[at : at + (1 << 16)] + np.arange(at, min(at + (1 << 16), len(raw)), dtype=np.uint64))
            h = K.mix(h ^ np.bitwise_xor.reduce(part))
        out[i, 0], out[i, 1] = h[0], K.mix(h)[0]
    return out, worded


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        halves, _ = fingerprints(batch.column("text"))
        halves = halves.view(np.int64)
        yield pa.RecordBatch.from_arrays([K.as_array(batch.column("doc_id")), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "f0", "f1"])


def _sample(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(BITS)[:count]


def _extract(f0: np.ndarray, f1: np.ndarray, positions: np.ndarray) -> np.ndarray:
    out = np.zeros(len(f0), np.uint64)
    for p in positions:
        half = f0 if p < 64 else f1
        out = (out << np.uint64(1)) | ((half >> np.uint64(p % 64)) & np.uint64(1))
    return out


def _keys(batches: Iterator[pa.RecordBatch], tables: int, sampled: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f0, f1 = (batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1"))
        for t in range(tables):
            key = K.mix(_extract(f0, f1, _sample(1000 + t, sampled)) | np.uint64(t << 40))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("node"), batch.column("f0"), batch.column("f1")], names=["key", "node", "f0", "f1"])


def _distance(f0, f1, a, b) -> np.ndarray:
    return np.bitwise_count(f0[a] ^ f0[b]).astype(np.int16) + np.bitwise_count(f1[a] ^ f1[b])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the pairs, so that a bucket sends a linear number of edges."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(names))
    return names[own], names[root[own]]


def _exact(f0: np.ndarray, f1: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what lies within the radius, by search from row to row among rows not yet reached."""
    left = np.arange(len(f0))
    a, b = [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(f0[left] ^ f0[at]).astype(np.int16) + np.bitwise_count(f1[left] ^ f1[at]) <= radius
            found = left[near]
            a.extend([at] * len(found))
            b.extend(found.tolist())
            frontier.extend(found.tolist())
            left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, cap: int, level: int, levels: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Edges of buckets up to the cap; rows of larger buckets, with additional bits in their keys.

    The rows come sorted by key. Kinds: 0 an edge (node, other); 1 a row to be put into buckets again. A bucket that is still too
    large after the last cut is searched exactly: at once up to ``block`` rows, else in pairs of blocks, each a
    bucket of the level beyond, where ``other`` says which of the two blocks a row is of.
    """

    def edges(a, b):
        if len(a):
            a, b = _forest(a, b)
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

    def blocks(key, node, side, f0, f1):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for s, e in zip(start, np.append(start[1:], len(key))):
            left, right = (np.flatnonzero(side[s:e] == k) + s for k in (0, 1))
            if len(right):
                found = [(at, right[np.bitwise_count(f0[right] ^ f0[at]).astype(np.int16) + np.bitwise_count(f1[right] ^ f1[at]) <= radius]) for at in left]
                a, b = np.concatenate([np.full(len(t), at) for at, t in found]), np.concatenate([t for _, t in found])
            else:
                a, b = _exact(f0[left], f1[left], radius)
                a, b = left[a], left[b]
            if len(a):
                yield edges(node[a], node[b])

    def buckets(key, node, other, f0, f1):
        if level > levels:
            yield from blocks(key, node, other, f0, f1)
            return
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        for s, z in zip(start[size > cap], size[size > cap]):
            cut = slice(s, s + z)
            if level >= levels and z > block:
                part = np.arange(z) // block
                n = int(part[-1]) + 1
                for i in range(n):
                    for j in range(i, n):
                        own = np.flatnonzero((part == i) | (part == j)) + s
                        pair = K.mix(K.mix(key[own].view(np.uint64) ^ np.uint64(i + 1)) ^ np.uint64(j + 1))
                        side = ((own - s) // block != i).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(own), np.int32)), pa.array(pair.view(np.int64)), pa.array(node[own]), pa.array(side), pa.array(f0[own].view(np.int64)), pa.array(f1[own].view(np.int64))], names=names)
                continue
            if level >= levels:
                a, b = _exact(f0[cut], f1[cut], radius)
                yield edges(node[cut][a], node[cut][b])
                continue
            for m in range(MORE_TABLES):
                bits = _extract(f0[cut], f1[cut], _sample(50_000 + 100 * level + m, MORE_BITS))
                again = K.mix(K.mix(key[cut].view(np.uint64) ^ np.uint64(m + 1)) ^ bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(z, np.int32)), pa.array(again.view(np.int64)), pa.array(node[cut]), pa.array(np.zeros(z, np.int64)), pa.array(f0[cut].view(np.int64)), pa.array(f1[cut].view(np.int64))], names=names)
        rest = np.repeat(np.where(size > cap, 1, size), size)
        end = np.repeat(start + size, size)
        at = np.flatnonzero(rest > 1)
        end = end[at]
        step, found = 1, []
        while len(at):
            more = at + step < end
            at, end = at[more], end[more]
            near = _distance(f0, f1, at, at + step) <= radius
            if near.any():
                found.append((at[near], at[near] + step))
            step += 1
        if found:
            yield edges(node[np.concatenate([x for x, _ in found])], node[np.concatenate([y for _, y in found])])

    names = ["kind", "key", "node", "other", "f0", "f1"]
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, other, f0, f1 = (batch.column(c).to_numpy() for c in ("key", "node", "other", "f0", "f1"))
        cols = (key, node, other, f0.view(np.uint64), f1.view(np.uint64))
        tail = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on in the next batch
        if tail == 0 and held and held[-1][0][-1] == key[0]:
            held.append(cols)
            continue
        done = [*held, tuple(c[:tail] for c in cols)]
        yield from buckets(*(np.concatenate(c) for c in zip(*done)))
        held = [tuple(c[tail:] for c in cols)]
    if held:
        yield from buckets(*(np.concatenate(c) for c in zip(*held)))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tables: int = TABLES, sampled: int = SAMPLED, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """``(doc_id, group_id, is_kept)``: one row per document with an id, group_id the least id of its group.

    A group is a connected component of the relation "SimHashes at most ``radius`` of 128 bits
    apart", over documents of equal SimHash taken as one. Candidates share the ``sampled``
    coordinates of one of the ``tables``; a bucket of more than ``cap`` distinct SimHashes is cut by
    additional coordinates, in several ways at once, and what is still too large after three
    cuts is searched exactly, in blocks that go to tasks of their own. Every candidate's distance is verified. Two near
    duplicates that meet only in oversized buckets are lost if their hashes differ in each of the cuts.

    Null text counts as empty. Texts without words group with exact copies only. Rows with a
    null doc_id can't be named in a group; they are left out here and kept by ``drop_duplicates``.
    A repeated doc_id is one document here; its texts' groups are joined. Ids are integers; a value that is none counts as null.
    Empty input gives no rows.
    Extra columns are ignored.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    prints = docs.select(integer("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    prints = written(prints.mapInArrow(_fingerprint_batches, "doc_id bigint, f0 bigint, f1 bigint"), f"{work}/prints")
    nodes = written(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("node")), f"{work}/nodes")
    rows = nodes.select("node", "f0", "f1").mapInArrow(lambda it: _keys(it, tables, sampled), "key bigint, node bigint, f0 bigint, f1 bigint").select("key", "node", F.lit(0).cast("bigint").alias("other"), "f0", "f1")
    found = None
    for level in range(LEVELS + 2):
        sorted_rows = rows.repartition("key").sortWithinPartitions("key")
        compared = sorted_rows.mapInArrow(lambda it, level=level: _compare(it, radius, cap, level, LEVELS, block), "kind int, key bigint, node bigint, other bigint, f0 bigint, f1 bigint")
        compared = written(compared, f"{work}/level{level}")
        edges = compared.where("kind = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
        found = edges if found is None else found.unionByName(edges)
        rows = compared.where("kind = 1").select("key", "node", "other", "f0", "f1")
        if rows.isEmpty():
            break
    # a doc_id that stands for several texts joins their nodes
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    named = prints.join(nodes, ["f0", "f1"]).select("doc_id", "node")
    named = written(named.distinct(), f"{work}/named")
    links = named.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = written(components(found.unionByName(links), f"{work}/cc").distinct(), f"{work}/roots")
    grouped = named.join(roots, named.node == roots.node, "left").select("doc_id", F.coalesce("root", named.node).alias("group_id"))
    grouped = grouped.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    return grouped.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("is_kept"))


def drop_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with one of each group left: the row of least doc_id, all columns as they were.

    Rows with a null doc_id, or one that is no integer, stay. Of several rows with the kept doc_id, one stays (the first by text).
    """
    work = shared_dir(docs.sparkSession)
    groups = near_duplicates(docs, **parameters)
    gone = written(groups.where("not is_kept").select(F.col("doc_id").alias("__gone")), f"{work}/gone")
    left = docs.join(gone, integer("doc_id") == gone["__gone"], "left_anti")
    # only ids that stand in several rows need a choice, so only their rows are shuffled
    ids = docs.select(integer("doc_id").alias("__twice")).where("__twice is not null")
    twice = written(ids.groupBy("__twice").count().where("count > 1").select("__twice"), f"{work}/twice")
    if twice.isEmpty():
        return left
    once = left.join(twice, integer("doc_id") == twice["__twice"], "left_anti")
    many = left.join(twice, integer("doc_id") == twice["__twice"], "left_semi")
    many = many.select(integer("doc_id").alias("id"), F.col("text").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    many = many.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("text"))).where("place = 1")
    return once.unionByName(many.select("row.*"))
