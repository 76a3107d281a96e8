import duckdb
import numpy as np

import corpus_pipeline
from rillgrid.llm import bpe, packing, quality_rules, simhash

from .conftest import DATA
from .test_bpe import reference
from .test_simhash import brute_force


def placed(lengths, capacity):
    """Windows and offsets of documents in the order of their ids, by trying every fill with the sum of squares written out."""
    open_windows, counts, out = {}, np.zeros(capacity, np.int64), []
    total = 0
    for doc, n in lengths:
        for piece, start in enumerate(range(0, n, capacity)):
            size = min(capacity, n - start)
            best = None
            for fill in [0, *(f for f in open_windows if open_windows[f] and f + size <= capacity)]:
                after = counts.copy()
                if fill:
                    after[fill] -= 1
                if fill + size < capacity:
                    after[fill + size] += 1
                score = (int((after**2).sum()), -fill)
                best = min(best or (score, fill), (score, fill))
            fill = best[1]
            if fill:
                window = open_windows[fill].pop()
                counts[fill] -= 1
            else:
                window, total = total, total + 1
            if fill + size < capacity:
                counts[fill + size] += 1
                open_windows.setdefault(fill + size, []).append(window)
            out.append((doc, piece, start, size, window, fill))
    return out


def test_stages_against_brute_force(spark):
    """Each stage against another way to its result: language by the declared one, rules by DuckDB, duplicates by all pairs, windows by all fills."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    (_, language), (_, rules), (_, duplicates), (_, packed) = corpus_pipeline.STAGES
    rows = {r.doc_id: r for r in documents.collect()}
    spoken = language(spark, documents, DATA)
    assert spoken.columns == documents.columns
    kept = {r.doc_id for r in spoken.collect()}
    sure = {i for i, r in rows.items() if r.lang and r.text and sum(c.isalpha() for c in r.text) > 60}
    assert len(sure) > 100 and len(sure - kept) <= 0.02 * len(sure)
    assert not kept & {i for i, r in rows.items() if not any(c.isalpha() for c in r.text or "")}

    con = duckdb.connect()
    con.register("documents", spoken.toArrow())
    good = {i for i, keep in con.execute(quality_rules.duckdb_sql()).fetchall() if keep}
    ruled = rules(spark, spoken, DATA)
    assert ruled.columns == documents.columns and sorted(r.doc_id for r in ruled.collect()) == sorted(good)

    groups = brute_force(sorted(good), [rows[i].text for i in sorted(good)], simhash.RADIUS)
    want = {i for i in good if groups[i] == i}
    single = duplicates(spark, ruled, DATA)
    left = {r.doc_id for r in single.collect()}
    assert single.columns == documents.columns
    assert left >= want and len(left - want) <= 0.1 * (len(good) - len(want))

    got = sorted(tuple(r) for r in packed(spark, single, DATA).collect())
    encoding = reference(bpe.VOCABULARY)
    lengths = [(i, len(encoding.encode_ordinary(rows[i].text))) for i in sorted(left)]
    assert got == placed(lengths, packing.CAPACITY)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == got


def test_stages_on_odd_rows(spark, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0
    table = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, DATA)
        assert table.columns == odd.columns
    kept = {r.doc_id for r in table.select("doc_id").collect()}
    assert 6 in kept and not kept & {2, 3, 4, 5, 7}
    last = corpus_pipeline.STAGES[-1][1](spark, table, DATA)
    assert {r.doc_id for r in last.select("doc_id").collect()} == kept
