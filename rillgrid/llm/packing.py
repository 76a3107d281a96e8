"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import integer, shared_dir, written

CAPACITY = 2048
DOCUMENTS_PER_SHARD = 20_000


class Packer:
    """Windows of one shard. ``levels[f]`` counts the windows filled up to ``f``, for 0 < f < capacity.

    A document of length s goes where the sum of squared levels ends up least: into a window at fill f, which
    takes one from level f and adds one to level f + s (a full window leaves the array), or into a new window.
    Ties go to the fullest window; of windows equally full, to the one that came to that fill last.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        # doubled counts, so that the ends of the array can hold the half steps: opening a window
        # saves no square, and filling one adds none
        self.levels = np.zeros(capacity + 1, np.int64)
        self.levels[0], self.levels[capacity] = 1, -1
        self.open: dict[int, list[int]] = {}
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset within it) of a document of 1 to ``capacity`` tokens."""
        capacity, levels = self.capacity, self.levels
        if size == capacity:
            self.windows += 1
            return self.windows - 1, 0
        gain = levels[size:] - levels[: capacity + 1 - size]
        gain[1:][levels[1 : capacity + 1 - size] == 0] = 1 << 40
        fill = len(gain) - 1 - int(gain[::-1].argmin())
        if fill:
            window = self.open[fill].pop()
            levels[fill] -= 2
        else:
            window = self.windows
            self.windows += 1
        if fill + size < capacity:
            levels[fill + size] += 2
            self.open.setdefault(fill + size, []).append(window)
        return window, fill


def pack(lengths: DataFrame, capacity: int = CAPACITY, documents_per_shard: int = DOCUMENTS_PER_SHARD) -> DataFrame:
    """Places ``(doc_id, n_tokens)``: ``(doc_id, piece, start, n_tokens, window_id, window_offset)``.

    Documents are dealt to shards by a hash of their id and length, and each shard is packed by itself in the order of
    id and length, so shards grow in number with the table and not in size. A document over the capacity fills
    windows of its own; its rest is placed like any other. ``start`` is the piece's first token in its document.
    A document without tokens (null and empty texts) has one row, with null window. Null ids come
    first in their shard; repeated ids are placed each by itself. Ids are integers; a value that is none counts as null. Null lengths
    count as 0.
    """
    lengths = lengths.select(integer("doc_id").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"))
    shards = max(1, -(-lengths.count() // documents_per_shard))
    rows = lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "n_tokens")
    names = ["doc_id", "piece", "start", "n_tokens", "window_id", "window_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for now, doc, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens"))):
                if now != shard:
                    shard, packer = now, Packer(capacity)
                base = shard << 32
                if n <= 0:
                    row = [(doc, 0, 0, 0, None, None)]
                else:
                    row = []
                    for piece, start in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - start)
                        window, offset = packer.place(size)
                        row.append((doc, piece, start, size, base + window, offset))
                for r in row:
                    for column, value in zip(out, r):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, n_tokens int, window_id bigint, window_offset int")


def pack_documents(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY, documents_per_shard: int = DOCUMENTS_PER_SHARD) -> DataFrame:
    """``pack`` of documents by their exact numbers of tokens. Extra columns are ignored."""
    counts = written(bpe.count_tokens(docs, path), f"{shared_dir(docs.sparkSession)}/lengths")
    return pack(counts, capacity, documents_per_shard)
