"""Exact token counts at every prefix of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K

BUDGETS = (512, 2048, 8192)
BLOCK = 2 << 20  # bytes of text worked on at a time, a dozen integers for each of which are held


def block_counts(coder: bpe.Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of every prefix that ends after a character, in a row, and each text's number of characters.

    A prefix's count is that of the pre-tokens before its last, plus that of the part of the last, which
    the table of distinct pre-tokens holds for every length. Two cuts change the pre-tokens themselves: one
    within a contraction leaves the quote by itself, and one right after white space makes one run of it.
    """
    chars, begins, starts, words, bounds, which = coder.split(data, offsets)
    n_docs = len(offsets) - 1
    first_char = np.searchsorted(chars, offsets)
    if not len(chars):
        return np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    inner = coder.prefix_counts_all(words, bounds).astype(np.int64)
    sizes = np.diff(bounds)
    # contractions of three bytes, cut before the last: a quote and a letter
    head = words[bounds[:-1]]
    three = np.flatnonzero((sizes == 3) & (head == 0x27))
    if len(three):
        second, third = words[bounds[three] + 1], words[bounds[three] + 2]
        cut = three[((second == ord("r")) | (second == ord("v"))) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))]
        inner[bounds[cut] + cut + 2] = 2
    totals = inner[bounds[1:] + np.arange(len(sizes))][which]
    before = np.cumsum(totals) - totals
    piece = np.cumsum(begins) - 1
    # bytes from the pre-token's begin to the end of each character
    end = np.append(chars[1:], len(data))
    within = end - starts[piece]
    counts = before[piece] + inner[bounds[which[piece]] + which[piece] + within]
    # white space before something else gives its last character away; a cut right after it takes it back
    space = _spaces(data, chars)
    last = np.flatnonzero(space[:-1] & ~space[1:])
    doc_first = np.zeros(len(chars) + 1, bool)
    doc_first[first_char[:-1]] = True
    last = last[~doc_first[last + 1]]
    start_of_run = np.maximum.accumulate(np.where(space & (doc_first[:-1] | ~np.append(False, space[:-1])), np.arange(len(chars)), 0))
    last = last[start_of_run[last] < last]
    if len(last):
        a, b = chars[start_of_run[last]], end[last]
        joined = bpe._runs(a, b - a)
        run_bounds = np.concatenate(([0], np.cumsum(b - a)))
        column = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(run_bounds.astype(np.int32)), pa.py_buffer(data[joined])]).dictionary_encode()
        each = np.array([len(coder.encode(r)) for r in column.dictionary.to_pylist()], np.int64)
        counts[last] = before[piece[start_of_run[last]]] + each[column.indices.to_numpy()]
    doc_base = np.append(before, totals.sum())[np.searchsorted(starts, offsets[:-1])]
    per_doc = np.diff(first_char)
    return counts - np.repeat(doc_base, per_doc), per_doc


def _spaces(data: np.ndarray, chars: np.ndarray) -> np.ndarray:
    lead = data[chars]
    space = (lead == 0x20) | (lead >= 9) & (lead <= 13)
    wide = np.flatnonzero((lead == 0xC2) | (lead == 0xE1) | (lead == 0xE2) | (lead == 0xE3))
    if len(wide):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
        at, b0 = chars[wide], lead[wide].astype(np.int64)
        b1, b2 = padded[at + 1] & 0x3F, padded[at + 2] & 0x3F
        code = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2)
        space[wide] = np.isin(code, bpe._SPACES)
    return space


def packed(counts: np.ndarray) -> tuple[bytes, int]:
    """Differences of successive counts, from 0, as integers of the narrowest of 1 or 4 bytes; and that width."""
    steps = np.diff(counts, prepend=0)
    if not len(steps) or -128 <= steps.min() and steps.max() <= 127:
        return steps.astype(np.int8).tobytes(), 1
    return steps.astype("<i4").tobytes(), 4


def unpacked(steps: bytes, width: int) -> np.ndarray:
    """Counts after 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(steps, np.int8 if width == 1 else "<i4"), dtype=np.int64)


def fitting(counts: np.ndarray, budget: int) -> int:
    """The most leading characters that make no more than ``budget`` tokens."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_table(docs: DataFrame, path: str = bpe.VOCABULARY, id_column: str = "doc_id", budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """``(id, n_tokens, n_characters, prefix_steps, step_bytes, fits_<budget>...)``, one row per row of ``docs``.

    ``prefix_steps`` holds the exact token count of every prefix of the text, as differences
    of ``step_bytes`` bytes each (``unpacked`` reads it); ``fits_b`` is the number of characters of
    the longest prefix of at most b tokens. Each prefix counts as a text by itself, cut anywhere between characters.
    Null text counts as empty: no steps, 0 tokens. Null and repeated ids pass through. Extra columns are ignored.
    """
    sent = bpe.sent_vocabulary(docs.sparkSession, path)
    names = [id_column, "n_tokens", "n_characters", "prefix_steps", "step_bytes", *(f"fits_{b}" for b in budgets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(sent)
        for batch in batches:
            ids = K.as_array(batch.column(id_column))
            data, offsets = K.text_buffer(batch.column("text"))
            for i, j in K.spans(offsets, BLOCK):
                counts, per_doc = block_counts(coder, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(per_doc)
                totals = np.where(per_doc > 0, np.append(counts, 0)[np.maximum(ends - 1, 0)], 0)
                steps, widths, fits = [], [], [[] for _ in budgets]
                for k, (a, b) in enumerate(zip(ends - per_doc, ends)):
                    own = counts[a:b]
                    blob, width = packed(own)
                    steps.append(blob)
                    widths.append(width)
                    for f, budget in zip(fits, budgets):
                        f.append(b - a if totals[k] <= budget else fitting(own, budget))
                columns = [pa.array(totals, pa.int64()), pa.array(per_doc, pa.int64()), pa.array(steps, pa.binary()), pa.array(widths, pa.int32()), *(pa.array(f, pa.int64()) for f in fits)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *columns], names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens bigint, n_characters bigint, prefix_steps binary, step_bytes int, " + ", ".join(f"fits_{b} bigint" for b in budgets)
    return docs.select(id_column, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
