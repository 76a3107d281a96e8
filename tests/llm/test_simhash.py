import random

import numpy as np
import pyarrow as pa
import pytest

from rillgrid.llm import kernels as K
from rillgrid.llm import simhash
from rillgrid.llm.common import components, shared_dir

from .conftest import sentence


def brute_force(ids, texts, radius):
    """Groups by all pairs of distances."""
    prints, _ = simhash.fingerprints(pa.array(texts, pa.string()))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        d = np.bitwise_count(prints[a] ^ prints[: a + 1]).sum(1)
        for b in np.flatnonzero(d[:a] <= radius):
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    return {i: find(i) for i in ids}


def copies(seed=1, groups=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 4000)}" for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edited = [w if rng.random() > 0.03 else f"z{rng.randint(0, 9999)}" for w in words]
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("cap, block", [(512, 4096), (4, 4096), (1, 2)])
def test_matches_all_pairs(spark, cap, block):
    texts = copies()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs, cap=cap, block=block).collect()}
    want = brute_force(list(range(len(texts))), texts, simhash.RADIUS)
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 20
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(got[i] == i for i in want if want[i] == i and i not in want.values())


def test_words_of_any_cut(spark):
    rng = random.Random(5)
    texts = [sentence(rng, n) for n in (0, 1, 5, 300)] + ["", "É é", None]
    data, offsets = K.text_buffer(pa.array(texts))
    whole = K.word_hashes(data, offsets)
    parts = K.word_hashes(data, offsets, block=16)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(set(K.word_hashes(*K.text_buffer(pa.array(["É é"])))[0])) == 1


def test_odd_rows(odd, nothing):
    got = {r.doc_id: (r.group_id, r.is_kept) for r in simhash.near_duplicates(odd).collect()}
    assert set(got) == set(range(1, 11))
    assert got[1] == (1, True) and got[7] == (6, False) and got[9] == (8, False)
    assert got[3][0] == 2 and got[5] == (5, True)  # null counts as empty; ### has no words
    left = simhash.drop_duplicates(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i) == [1, 2, 4, 5, 6, 8, 10] and ids.count(None) == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_duplicates(nothing).count() == 0


def test_large_buckets_are_searched_whole(spark):
    """Hashes that agree in all but a few bits meet in every bucket, and in spite of all cuts."""
    rng = np.random.default_rng(4)
    f0 = np.full(60, 12345, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    key = np.full(60, 7, np.int64)
    cols = [key, np.arange(60), np.zeros(60, np.int64), f0.view(np.int64), np.zeros(60, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "other", "f0", "f1"])
    out = pa.Table.from_batches(list(simhash._compare(iter([batch]), 2, 4, 3, 3, block=16)))
    assert set(out["kind"].to_pylist()) == {1}
    again = out.sort_by("key").combine_chunks().to_batches()[0].select(["key", "node", "other", "f0", "f1"])
    found = pa.Table.from_batches(list(simhash._compare(iter([again]), 2, 4, 4, 3, block=16)))
    root = list(range(60))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(found["node"].to_pylist(), found["other"].to_pylist()):
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert {top(i) for i in range(60)} == {0}


def test_ids_that_are_no_integers_and_long_texts(spark, very_long):
    words = spark.createDataFrame([("1", "one text of some words"), ("2", "one text of some words"), ("x", "one text of some words"), (None, "y")], "doc_id string, text string")
    assert {(r.doc_id, r.group_id) for r in simhash.near_duplicates(words).collect()} == {(1, 1), (2, 1)}
    assert sorted(str(r.doc_id) for r in simhash.drop_duplicates(words).collect()) == ["1", "None", "x"]
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(very_long).collect()}
    assert got[1] == got[2] == got[5] == 1 and got[3] == 3 and got[4] == 4


def test_components_of_chains(spark):
    rng = random.Random(2)
    edges, want = [], {}
    for c in range(20):
        members = [c * 1000 + k for k in range(rng.randint(2, 60))]
        order = members[:]
        rng.shuffle(order)
        edges += list(zip(order, order[1:]))
        want |= {m: members[0] for m in members}
    table = spark.createDataFrame(edges + edges[:5], "a long, b long")
    assert {r.node: r.root for r in components(table, shared_dir(spark)).collect()} == want
    assert components(table.limit(0), shared_dir(spark)).count() == 0
