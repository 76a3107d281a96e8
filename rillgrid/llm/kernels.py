"""Vectorised numpy kernels over Arrow text batches.

Texts arrive as Arrow string arrays, so the bytes of a whole batch lie in one buffer. The
kernels here work on that buffer rather than on Python strings: no per-row Python work in
the hot path, and memory is bounded by cutting the buffer into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INV_BASE = pow(_BASE, -1, 1 << 64)


def as_array(column) -> pa.Array:
    """One contiguous array from an array or a chunked array."""
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; a null text counts as an empty one.

    Called once a batch, it also has Arrow give back the memory of batches gone by.
    """
    pa.default_memory_pool().release_unused()
    column = as_array(column)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents whose bytes sum to about one block; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x += _SEED
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# 1: word byte (letters, digits, every byte of a multi-byte character); 0: separator
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters, in place of their bytes."""
    out = _LOWER[data]
    if len(out) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        if upper.any():
            out[1:][upper] += 0x20
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INV_BASE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POWERS: list[np.ndarray] = []


def word_hashes(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word in order, for the documents that ``offsets`` bounds.

    Words are runs of letters, digits and multi-byte characters, in lower case. The hash of a
    word is its polynomial in a 64-bit ring, read off prefix sums, so words cost no loop. The
    buffer is cut at word ends into blocks, which bounds memory for texts of any length.
    """
    hashes, starts_at = [], []
    begin, end = int(offsets[0]), int(offsets[-1])
    if not _POWERS or len(_POWERS[0]) < block + 2:
        _POWERS[:] = _powers(block + 1)
    at = begin
    bounds = np.zeros(end - begin + 1, bool)
    bounds[offsets - begin] = True  # a word never runs over a document's end
    while at < end:
        stop = min(at + block, end)
        if stop < end:
            tail = _WORD[data[at:stop]] & ~bounds[at - begin + 1 : stop - begin + 1]
            cut = np.flatnonzero(~tail)
            if len(cut):
                stop = at + int(cut[-1]) + 1
        low = fold(data[at:stop])
        word = _WORD[low]
        edge = bounds[at - begin : stop - begin]
        before = np.concatenate(([False], word[:-1]))
        first = np.flatnonzero(word & (~before | edge))
        after = np.concatenate((~word[1:] | edge[1:], [True]))
        last = np.flatnonzero(word & after)
        if len(first):
            sums = np.zeros(len(low) + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(low)], out=sums[1:])
            value = (sums[last + 1] - sums[first]) * _POWERS[1][first]
            hashes.append(mix(value ^ ((last - first).astype(np.uint64) << np.uint64(56))))
            starts_at.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(offsets, np.concatenate(starts_at), "right") - 1


def trigram_codes(data: np.ndarray, bits: int) -> np.ndarray:
    """Hash to ``bits`` bits of the byte trigram starting at each byte but the last two, of folded bytes."""
    low = fold(data).astype(np.uint32)
    code = low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - bits)).astype(np.int32)


def histograms(data: np.ndarray, offsets: np.ndarray, i: int, j: int, bits: int) -> np.ndarray:
    """Trigram counts, one row of 2**bits for each of documents i to j (exclusive)."""
    width = 1 << bits
    out = np.zeros((j - i, width), np.float32)
    if j - i == 1:
        # a long document: in blocks, overlapping by two bytes
        for at in range(int(offsets[i]), int(offsets[j]) - 2, BLOCK_BYTES):
            part = data[at : min(at + BLOCK_BYTES + 2, int(offsets[j]))]
            out[0] += np.bincount(trigram_codes(part, bits), minlength=width)
        return out
    part = data[offsets[i] : offsets[j]]
    if len(part) < 3:
        return out
    codes = trigram_codes(part, bits)
    sizes = np.diff(offsets[i : j + 1])
    owner = np.repeat(np.arange(j - i), sizes)[: len(codes)]
    ends = (offsets[i + 1 : j + 1] - offsets[i])[owner]
    inside = np.arange(len(codes)) + 2 < ends
    key = owner[inside] * width + codes[inside]
    return np.bincount(key, minlength=(j - i) * width).reshape(j - i, width).astype(np.float32)
