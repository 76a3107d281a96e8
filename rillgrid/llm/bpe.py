"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 2 << 20  # bytes of text whose distinct pre-tokens are encoded together
_L, _N, _S, _O = 0, 1, 2, 3
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        table = np.full(0x110000, _O, np.uint8)
        kinds = "".join(unicodedata.category(chr(i))[0] for i in range(0x110000))
        kinds = np.frombuffer(kinds.encode("ascii"), np.uint8)
        table[kinds == ord("L")], table[kinds == ord("N")] = _L, _N
        table[_SPACES] = _S
        _CLASSES.append(table)
    return _CLASSES[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens of the texts that ``offsets`` bounds within ``data``, and the texts' characters.

    The rule is the common one of byte-level vocabularies: contractions; runs of letters, of
    numbers or of other characters, each with one space before it; white space, of which the
    last character goes with what follows. It is applied to whole arrays of character classes.
    Returns the byte positions of characters, whether a pre-token begins at each, and their classes.
    """
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[chars]
    table = _classes()
    kind = table[lead]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        at, b0 = chars[wide], lead[wide].astype(np.int64)
        padded = np.append(data, np.zeros(3, np.uint8))
        b1, b2, b3 = (padded[at + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
        code = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
        kind[wide] = table[np.minimum(code, 0x10FFFF)]
    n = len(chars)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(chars, offsets[:-1])] = True
    first = first[:n]
    if not n:
        return chars, first, kind
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    begins = change.copy()
    after = np.flatnonzero(change[1:] & ~first[1:] & (kind[1:] != _S) & (kind[:-1] == _S)) + 1
    begins[after - 1] = True
    begins[after[lead[after - 1] == 0x20]] = False
    quote = np.flatnonzero((lead == 0x27) & begins)
    if len(quote):
        pad, starts = np.append(lead, np.zeros(3, np.uint8)), np.append(first, np.ones(3, bool))
        a, b = pad[quote + 1], pad[quote + 2]
        near, far = ~starts[quote + 1], ~starts[quote + 1] & ~starts[quote + 2]
        short = near & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = far & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for where, size in ((short, 2), (long, 3)):
            q = quote[where]
            for k in range(1, size):
                begins[q + k] = False
            q = q[q + size < n]
            begins[q + size] = True
    return chars, begins, kind


class Vocabulary:
    """Tokens by id, in the order of their merges."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        ranks = {}
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    ranks[int(rank)] = base64.b64decode(token)
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError("the ranks must run from 0 without gaps")
        if len(ranks) > 1 << 20:
            raise ValueError("the table of pairs takes vocabularies of at most 1,048,576 tokens")
        return cls([ranks[i] for i in range(len(ranks))])


class _Table:
    """Open addressing over non-negative int64 keys, probed by whole arrays."""

    def __init__(self, bits: int, probes: int):
        self.bits, self.probes = bits, probes
        self.keys = np.full((1 << bits) + probes, -1, np.int64)
        self.values = np.full((1 << bits) + probes, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where a key is absent."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(left):
                break
            at = slot[left] + step
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (self.keys[at] != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> bool:
        """Enters distinct new keys; False if one found no place within the probes."""
        whole = True
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist()):
            for at in range(slot, slot + self.probes):
                if self.keys[at] == -1:
                    break
            else:
                whole = False
                at = slot + self.probes - 1  # a table of answers may forget one; the trie may not
            self.keys[at], self.values[at] = key, value
        return whole


class Encoder:
    """Encodes pre-tokens; made once in each Python worker.

    Blocks of distinct pre-tokens are encoded together: the automaton's trie is walked from all places at once, which
    gives every place its longest token and all shorter ones, and the backtracking search takes one
    step in all pre-tokens at a time, of whatever length. The last ``FEW``, which are the longest, go on one by one.
    """

    WIDEST = 64
    FEW = 8

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.size = [len(t) for t in self.tokens]
        self.automaton = None
        self.parts: dict[int, tuple[int, int]] = {}
        # the offset table of decoding: all tokens' bytes in a row, and where each begins
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.size)))
        self.sizes = np.array(self.size, np.int64)
        self.pairs = _Table(21, 6)
        children: dict[int, int] = {}
        ends = [-1]
        self.shorter = np.full(len(self.tokens), -1, np.int32)  # the longest token that properly begins each
        for token, text in sorted(enumerate(self.tokens), key=lambda x: len(x[1])):
            node, seen = 0, -1
            for byte in text:
                if ends[node] >= 0:
                    seen = ends[node]
                node = children.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node], self.shorter[token] = token, seen
        self.ends = np.array(ends, np.int32)
        self.trie = _Table(max(10, len(children).bit_length() + 2), 32)
        if not self.trie.put(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int32, len(children))):
            raise ValueError("the trie's table is too full")

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``, itself twice for a single byte."""
        found = self.parts.get(token)
        if found is None:
            text = self.tokens[token]
            parts = [text[k : k + 1] for k in range(len(text))]
            while len(parts) > 2:
                ranks = [self.ids.get(a + b, token) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                k = ranks.index(best)
                if best >= token:
                    raise ValueError(f"token {token} can't be reached by merges")
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = (token, token) if len(parts) < 2 else (self.ids[parts[0]], self.ids[parts[1]])
            self.parts[token] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes, joined, encode to just these two tokens.

        Undoes the two tokens' merges at their common border, latest first. A merge across the border that
        would have come before the one just undone makes the pair impossible.
        """
        before = len(self.tokens)
        while True:
            across = self.ids.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < before:
                return False
            inner_a, inner_b = self.size[a] > 1, self.size[b] > 1
            # of equal tokens the left one was merged first, so the right one is undone first
            if inner_a and (a > b or not inner_b):
                before, a = a, self._halves(a)[1]
            elif inner_b:
                before, b = b + (b >= a), self._halves(b)[0]
            else:
                return True

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of whole arrays, through the table of pairs; pairs not in it are worked out once."""
        keys = a.astype(np.int64) << 20 | b
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, where = np.unique(keys[new], return_inverse=True)
            answers = np.array([self.compatible(k >> 20, k & 0xFFFFF) for k in distinct.tolist()], np.int32)
            self.pairs.put(distinct, answers)
            found[new] = answers[where]
        return found > 0

    def _walk(self, data: np.ndarray, ends: np.ndarray, every: bool):
        """The longest token beginning at each byte and ending within its pre-token; all of them if ``every``."""
        longest = np.full(len(data), -1, np.int32)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        found = []
        while len(at):
            node = self.trie.get(node << 8 | data[at + depth])
            there = node >= 0
            at, node = at[there], node[there].astype(np.int64)
            depth += 1
            token = self.ends[node]
            hit = token >= 0
            longest[at[hit]] = token[hit]
            if every:
                found.append((at[hit], token[hit]))
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        return longest, found

    def _matches(self, piece: bytes) -> Iterator[tuple[int, int]]:
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.tokens):
                self.automaton.add_word(t.decode("latin-1"), i)
            self.automaton.make_automaton()
        return self.automaton.iter(piece.decode("latin-1"))

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token: the longest match at each place, taken back where it fits nothing."""
        if piece in self.ids:
            return [self.ids[piece]]
        n, size = len(piece), self.size
        longest = [-1] * (n + 1)
        for end, token in self._matches(piece):
            longest[end + 1 - size[token]] = token  # ends ascend, so the longest comes last
        return self._search(longest, n)

    def _search(self, longest: list[int], n: int) -> list[int]:
        """The backtracking search over a pre-token of n bytes, given the longest token at each place."""
        size = self.size
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or out and not self.compatible(out[-1], token)):
                token = int(self.shorter[token])
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def encode_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of all pre-tokens between the bounds: their tokens in a row, and the number of each."""
        lengths = np.diff(bounds)
        longest, _ = self._walk(data, np.repeat(bounds[1:], lengths), False)
        first = longest[bounds[:-1]]
        if len(first) and first.min() < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        counts = np.ones(len(lengths), np.int64)
        many = np.flatnonzero(self.sizes[first] < lengths)
        at, stop, token = bounds[many].astype(np.int64), bounds[many + 1], first[many]
        base, depth = at.copy(), np.zeros(len(many), np.int64)
        stack = np.zeros(len(data) + 1, np.int32)  # a pre-token has no more tokens than bytes
        dead = np.zeros(len(data) + 1, bool)
        live = np.arange(len(many))
        while len(live) > self.FEW:
            t, d, p = token[live], depth[live], at[live]
            end = p + self.sizes[t]
            good = ~dead[end] | (end == stop[live])
            check = np.flatnonzero(good & (d > 0))
            good[check] = self.all_compatible(stack[base[live[check]] + d[check] - 1], t[check])
            go = live[good]
            stack[base[go] + d[good]] = t[good]
            depth[go] += 1
            at[go] = end[good]
            done = end[good] == stop[go]
            onward = go[~done]
            token[onward] = longest[at[onward]]
            bad = live[~good]
            less = self.shorter[t[~good]]
            token[bad[less >= 0]] = less[less >= 0]
            back = bad[less < 0]
            if len(back):
                if depth[back].min() == 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at[back]] = True
                depth[back] -= 1
                token[back] = stack[base[back] + depth[back]]
                at[back] -= self.sizes[token[back]]
            live = np.concatenate((onward, bad))
        for k in live:
            a, b = int(bounds[many[k]]), int(bounds[many[k] + 1])
            found = self._search([*longest[a:b].tolist(), -1], b - a)
            stack[a : a + len(found)] = found
            depth[k] = len(found)
        counts[many] = depth
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        one = np.ones(len(lengths), bool)
        one[many] = False
        out[starts[one]] = first[one]
        out[_runs(starts[many], depth)] = stack[_runs(base, depth)]
        return out, counts

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Number of tokens of each prefix of a pre-token's bytes, the empty one first, by dynamic programming.

        The encoding of a prefix ends in the one token that is compatible with the last token of what precedes it.
        """
        n, size = len(piece), self.size
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, token in self._matches(piece):
            end += 1
            if last[end] < 0:
                begin = end - size[token]
                if begin == 0 or last[begin] >= 0 and self.compatible(last[begin], token):
                    last[end] = token
                    count[end] = count[begin] + 1
        return count

    def prefix_counts_all(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``prefix_counts`` of all pre-tokens between the bounds, in a row."""
        lengths = np.diff(bounds)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        _, found = self._walk(data, bounds[1:][owner], True)
        last, count = np.full(len(data) + len(lengths), -1, np.int32), np.zeros(len(data) + len(lengths), np.int32)
        begin = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        token = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int32)
        own = owner[begin]
        wide = lengths[own] > 4 * self.WIDEST
        for m in np.flatnonzero(lengths > 4 * self.WIDEST):
            at = int(bounds[m] - bounds[0]) + int(m)
            count[at : at + int(lengths[m]) + 1] = self.prefix_counts(data[bounds[m] : bounds[m + 1]].tobytes())
        begin, token, own = begin[~wide], token[~wide], own[~wide]
        rank = begin - bounds[own] + self.sizes[token]
        order = np.argsort(rank.astype(np.int16), kind="stable")
        begin, token, rank, own = begin[order], token[order], rank[order], own[order]
        source = begin + own
        cuts = np.searchsorted(rank, np.arange(1, (int(rank[-1]) if len(rank) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, t = source[a:b], token[a:b]
            fits = begin[a:b] == bounds[own[a:b]]
            check = np.flatnonzero(~fits & (last[s] >= 0))
            fits[check] = self.all_compatible(last[s[check]], t[check])
            s, t = s[fits], t[fits]
            e = s + self.sizes[t]
            last[e] = t
            count[e] = count[s] + 1
        return count

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """Characters and pre-tokens of a block, its distinct pre-tokens' bytes and bounds, and which of them each is."""
        chars, begins, _ = pieces(data, offsets)
        starts = chars[begins]
        bounds = np.append(starts, len(data)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = column.dictionary_encode()
        buffers = coded.dictionary.buffers()
        if not len(coded.dictionary):
            return chars, begins, starts, data[:0], np.zeros(1, np.int64), np.zeros(0, np.int64)
        own = np.frombuffer(buffers[1], np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        return chars, begins, starts, np.frombuffer(buffers[2], np.uint8)[: own[-1]], own, coded.indices.to_numpy()

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of a block of texts in a row, and each text's number of tokens."""
        _, _, starts, words, bounds, which = self.split(data, offsets)
        flat, counts = self.encode_all(words, bounds)
        length = counts[which]
        tokens = flat[_runs((np.cumsum(counts) - counts)[which], length)]
        ends = np.concatenate(([0], np.cumsum(length)))
        return tokens, np.diff(ends[np.searchsorted(starts, offsets)])

    def count_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's number of tokens."""
        _, _, starts, words, bounds, which = self.split(data, offsets)
        ends = np.concatenate(([0], np.cumsum(self.encode_all(words, bounds)[1][which])))
        return np.diff(ends[np.searchsorted(starts, offsets)])

    def decode_block(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, gathered through the offset table."""
        return self.bytes[_runs(self.starts[tokens], self.sizes[tokens])]


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each run, in a row."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


_ENCODERS: dict[str, Encoder] = {}


def sent_vocabulary(spark: SparkSession, path: str):
    """The vocabulary as a broadcast of fixed size, read by the driver alone."""
    return path, spark.sparkContext.broadcast(Vocabulary.load(path))


def encoder(sent) -> Encoder:
    """This worker's encoder."""
    path, vocabulary = sent
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(vocabulary.value)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, tokens, n_tokens, is_lossless)``, one row per row of ``docs``.

    ``tokens`` are those of plain byte-pair merging with the vocabulary at ``path``; nothing in a text is read as a special
    token. Each row is decoded again, and ``is_lossless`` says whether its bytes came back.
    Null text has null tokens, n_tokens 0; empty text has no tokens. Null and repeated
    ids pass through. Extra columns are ignored.
    """
    sent = sent_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent)
        for batch in batches:
            column, ids = K.as_array(batch.column("text")), batch.column(id_column)
            data, offsets = K.text_buffer(column)
            for i, j in K.spans(offsets, BLOCK):
                block, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                tokens, counts = coder.encode_block(block, bounds)
                same = np.concatenate(([0], np.cumsum(coder.decode_block(tokens) != block)))
                missing = column.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens, pa.int32()), mask=pa.array(missing))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists, pa.array(counts.astype(np.int32)), pa.array(same[bounds[1:]] == same[bounds[:-1]])], names=[id_column, "tokens", "n_tokens", "is_lossless"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, tokens array<int>, n_tokens int, is_lossless boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """``(id, text)`` of ``(id, tokens)``; null tokens give null text. Ids outside the vocabulary are an error."""
    sent = sent_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent)
        for batch in batches:
            lists = K.as_array(batch.column("tokens"))
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(coder.tokens)):
                raise ValueError("a token is outside the vocabulary")
            counts = lists.value_lengths().fill_null(0).to_numpy()
            sizes = np.concatenate(([0], np.cumsum(coder.sizes[tokens])))
            ends = sizes[np.concatenate(([0], np.cumsum(counts)))]
            texts = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(coder.decode_block(tokens).tobytes())])
            texts = pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), texts], names=[id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "tokens").mapInArrow(run, f"`{id_column}` {kind}, text string")


def count_tokens(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """``(id, n_tokens)``; null text has 0 tokens."""
    sent = sent_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent)
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j in K.spans(offsets, BLOCK):
                block, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                counts[i:j] = coder.count_block(block, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(counts)], names=[id_column, "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")
