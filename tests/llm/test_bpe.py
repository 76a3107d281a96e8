import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from rillgrid.llm import bpe, packing, token_counts
from rillgrid.llm import kernels as K

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MULTI = bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")


def reference(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    alphabet = list("abeiost'rlvdm .\n\t!?12é漢🙂 　") + ["'ll", "'re", "'s", "  ", "the "]
    texts = ["I'll say it's we're 'x' 've don'tt 's't a'  b\n\n c   d\t'll  ", "", "   ", "\n", "!!'s ''s 'S _a_ 'l 'r", "<|endoftext|>", "a" * 1000, "ab" * 500, "!" * 333, " " * 50 + "x"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [bpe.VOCABULARY, MULTI])
def test_exact_tokens(path):
    texts, want = odd_texts(), reference(path)
    coder = bpe.Encoder(bpe.Vocabulary.load(path))
    data, offsets = K.text_buffer(pa.array(texts))
    tokens, counts = coder.encode_block(data, offsets)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for i, text in enumerate(texts):
        assert tokens[ends[i] : ends[i + 1]].tolist() == want.encode_ordinary(text), text
    assert (coder.decode_block(tokens) == data).all()
    for text in texts[:40]:
        for piece in want.decode_tokens_bytes(want.encode_ordinary(text)):
            assert coder.encode(piece) == coder.encode_all(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))[0].tolist()


def test_every_prefix():
    texts, want = odd_texts(300, 7), reference(bpe.VOCABULARY)
    coder = bpe.Encoder(bpe.Vocabulary.load(bpe.VOCABULARY))
    data, offsets = K.text_buffer(pa.array(texts))
    counts, sizes = token_counts.block_counts(coder, data, offsets)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert b - a == len(text)
        own = counts[a:b]
        assert own.tolist() == [len(want.encode_ordinary(text[:k])) for k in range(1, len(text) + 1)], text
        assert (token_counts.unpacked(*token_counts.packed(own)) == own).all()
        for budget in (0, 3, 10):
            assert token_counts.fitting(own, budget) == max([0, *(k + 1 for k, n in enumerate(own) if n <= budget)])


def test_tables(spark, odd, nothing, odd_rows):
    want = reference(bpe.VOCABULARY)
    encoded = bpe.encode(odd)
    rows = encoded.collect()
    assert sorted((r.n_tokens for r in rows)) == sorted(len(want.encode_ordinary(r[1] or "")) for r in odd_rows)
    assert all(r.is_lossless for r in rows) and sum(r.tokens is None for r in rows) == 2
    back = bpe.decode(encoded)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted((r[:2] for r in odd_rows), key=str)
    table = token_counts.prefix_table(odd, budgets=(5, 100))
    for r in table.collect():
        assert r.n_characters == len(token_counts.unpacked(r.prefix_steps, r.step_bytes)) and r.fits_5 <= r.fits_100 <= r.n_characters
    assert table.count() == len(odd_rows)
    for f in (bpe.encode, token_counts.prefix_table, bpe.count_tokens, packing.pack_documents):
        assert f(nothing).count() == 0


def sum_of_squares(sizes, capacity):
    """Places by trying every fill level and adding up all squares."""
    levels, windows, out = {}, [], []
    for size in sizes:
        if size == capacity:
            windows.append(capacity)
            out.append((len(windows) - 1, 0))
            continue
        best = None
        for fill in [0, *(f for f, n in levels.items() if n)]:
            if fill + size > capacity:
                continue
            trial = dict(levels)
            if fill:
                trial[fill] -= 1
            if fill + size < capacity:
                trial[fill + size] = trial.get(fill + size, 0) + 1
            score = (sum(n * n for n in trial.values()), -fill)
            if best is None or score < best[0]:
                best = (score, fill, trial)
        _, fill, levels = best
        if fill:
            window = max((i for i, f in enumerate(windows) if f == fill), key=lambda i: stamp[i])
        else:
            windows.append(0)
            window = len(windows) - 1
            stamp = {} if window == 0 else stamp
        windows[window] += size
        stamp[window] = len(out)
        out.append((window, fill))
    return out


def test_packing_is_sum_of_squares():
    rng = random.Random(4)
    for capacity in (8, 50):
        sizes = [rng.randint(1, capacity - 1) for _ in range(250)]
        packer = packing.Packer(capacity)
        assert [packer.place(s) for s in sizes] == sum_of_squares(sizes, capacity)


def test_windows_hold_everything_once(spark, odd, odd_rows):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 300)) for i in range(3000)] + [(5, 70), (None, 12), (None, None), (77, 10_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 128, 500).collect()
    total = sum(r[1] or 0 for r in rows)
    assert sum(r.n_tokens for r in got) == total
    windows = {}
    for r in got:
        if r.window_id is not None:
            windows.setdefault(r.window_id, []).append((r.window_offset, r.n_tokens))
        else:
            assert r.n_tokens == 0
    for placed in windows.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 128
    assert total / 128 / len(windows) > 0.93
    assert {r.doc_id for r in packing.pack_documents(odd).collect()} == {r[0] for r in odd_rows}


def test_very_long_texts_and_other_ids(spark, very_long):
    want = reference(bpe.VOCABULARY)
    texts = {r.doc_id: r.text for r in very_long.collect()}
    size = {i: len(want.encode_ordinary(t)) for i, t in texts.items() if i != 4}
    encoded = {r.doc_id: r for r in bpe.encode(very_long).select("doc_id", "n_tokens", "is_lossless").collect()}
    counted = {r.doc_id: r.n_tokens for r in token_counts.prefix_table(very_long).select("doc_id", "n_tokens").collect()}
    packed = packing.pack_documents(very_long.selectExpr("concat('', doc_id) as doc_id", "text")).groupBy("doc_id").sum("n_tokens").collect()
    for i, n in size.items():
        assert encoded[i].n_tokens == counted[i] == n and encoded[i].is_lossless
    assert encoded[4].is_lossless and encoded[4].n_tokens == counted[4]
    assert {r.doc_id: r[1] for r in packed} == counted
    some = spark.createDataFrame([("x", 5), (None, 7), ("3", 9)], "doc_id string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in packing.pack(some).collect()) == [(0, 5), (0, 7), (3, 9)]
