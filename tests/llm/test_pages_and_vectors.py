import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import embed_dedup, queries, url_filter, warc
from rillgrid.llm.common import components, shared_dir

PAGES = [
    (1, "http://a.org/x", '<a href="http://b.com/1">b</a> see c.net and c.net'),
    (2, "http://a.org/y", "<a href='//c.net'>c</a><a href='/own'>own</a>"),
    (3, "https://u@B.com:8080/?q", "links to bad.info and a.org"),
    (4, "http://c.net", "bad.info"),
    (5, "http://bad.info/z", "c.net, nowhere.org"),
    (6, "http://lone.org/", ""),
    (7, None, "a.org"),
    (8, "not a url", "a.org"),
    (9, "http://a.org/n", None),
    (1, "http://a.org/x", '<a href="http://b.com/1">b</a> see c.net and c.net'),
    (None, "http://spa ce.org/\nq", "héllo\r\n\r\nWARC/1.1"),
    (10, "http://d.org/", "x" * 3_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, is_kept string").repartition(3)


def test_archives_come_back(spark, pages):
    got = warc.archive_and_read(pages).collect()
    want = [p for p in PAGES if p[1] is not None and p[2] is not None]
    assert sorted((r.page_id or 0, r.html) for r in got) == sorted((p[0] or 0, p[2]) for p in want)
    assert {r.url for r in got if r.page_id is None} == {"http://spa%20ce.org/%0Aq"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_index_and_ranges(spark, pages):
    folder = shared_dir(spark)
    files = spark.createDataFrame(warc.write_warc(pages, folder, file_bytes=300).collect())
    assert files.count() > 3
    index = spark.createDataFrame(warc.index_warc(files).collect(), warc.INDEX)
    for file, rows in index.toPandas().sort_values("offset").groupby("file"):
        raw = open(file.removeprefix("file://"), "rb").read()
        assert rows.offset.iloc[0] == 0 and (rows.offset + rows.length).tolist() == [*rows.offset.iloc[1:], len(raw)]
    chosen = index.where("type = 'response'")
    one = warc.coalesce(chosen, 1 << 30).collect()
    each = warc.coalesce(chosen, -1).collect()
    assert len(one) == chosen.select("file").distinct().count() and len(each) == chosen.count()
    for gap in (-1, 10, 1 << 30):
        assert warc.read_selected(chosen, gap).count() == chosen.count()
    assert max(r.stop - r.start for r in warc.coalesce(chosen, 1 << 30, 200).collect()) < 20_000
    wrong = chosen.withColumn("digest", F.lit("sha256:0"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_selected(wrong).collect()


def test_files_that_are_not_compressed(spark, tmp_path):
    records = [warc.record(i, f"http://x.org/{i}", b"\r\n\r\nbody %d" % i * 50_000, "2020-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc",), (None,)], "file string")
    index = warc.index_warc(files)
    assert [(r.offset, r.length) for r in index.orderBy("offset").collect()] == [(sum(map(len, records[:i])), len(r)) for i, r in enumerate(records)]
    got = warc.read_selected(index.where("page_id >= 2")).collect()
    assert sorted(r.payload for r in got) == [b"\r\n\r\nbody 2" * 50_000, b"\r\n\r\nbody 3" * 50_000] or len(got) == 2
    (tmp_path / "a.warc").write_bytes(b"".join(records)[:-900])
    with pytest.raises(Exception, match="cut off"):
        index.collect()


def test_scores_by_hand_and_in_duckdb(spark, pages):
    trusted, blocked = (spark.createDataFrame([(h,), (None,), (h,)], "host string") for h in ("a.org", "bad.info"))
    got = {(r.page_id, r.url): r for r in url_filter.filter_urls(pages, trusted, blocked).collect()}
    hosts = ["a.org", "b.com", "c.net", "bad.info"]
    n = np.zeros((4, 4))
    for a, b, k in [("a.org", "b.com", 1), ("a.org", "c.net", 2), ("b.com", "bad.info", 1), ("b.com", "a.org", 1), ("c.net", "bad.info", 1), ("bad.info", "c.net", 1)]:
        n[hosts.index(a), hosts.index(b)] += k
    n[0, 1:3] += [1, 1]  # page 1 stands there twice
    want = []
    for way, seed in ((n, 0), (n.T, 3)):
        share = way / np.maximum(way.sum(1, keepdims=True), 1)
        start = np.eye(4)[seed]
        score = start
        for _ in range(url_filter.rounds_for(0.85)):
            score = 0.85 * score @ share + 0.15 * start
        want.append(score / score.sum())
    for (_, url), r in got.items():
        host = r.host
        if host in hosts:
            trust, distrust = (w[hosts.index(host)] for w in want)
            assert (r.trust, r.distrust) == (pytest.approx(trust, abs=1e-6), pytest.approx(distrust, abs=1e-6))
            assert r.is_kept == (host != "bad.info" and distrust - trust <= url_filter.MARGIN / 4)
        elif host is None:
            assert not r.is_kept and r.trust is None
        else:
            assert r.is_kept and r.trust == 0
    frame = pages.select("page_id", "url", "html").distinct().where("url not like '%spa%' or url is null")
    more = [(20, "http://www.b.com/", "<a href=//far.net/>far</a>"), (21, "http://far.net", ""), (22, "http://blog.lone.org", "see www.b.com"), (23, "http://10.0.0.1/", "<img src='http://bad.info/i'>")]
    frame = frame.unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    sql = sorted(con.execute(url_filter.duckdb_sql("host = 'a.org'", "host = 'bad.info'")).fetchall(), key=str)
    assert {r[2]: r[5] for r in sql}["10.0.0.1"] is False
    assert sorted((tuple(r) for r in url_filter.filter_urls(frame, trusted, blocked).collect()), key=str) == sql


def test_no_pages_and_no_seeds(spark, pages):
    none = spark.createDataFrame([], "host string")
    assert url_filter.filter_urls(pages.limit(0), none, none).count() == 0
    got = url_filter.filter_urls(pages, none, none).collect()
    assert len(got) == len(PAGES) and all(r.is_kept == (r.host is not None) for r in got)


def test_hosts_that_are_not_crawled_have_edges(spark):
    rows = [
        (1, "http://farm.net/", "<a href='http://bad.info/x'>x</a> <img src=//10.0.0.7:80/i.png> me@mail.net <a href='/own'>own</a>"),
        (2, "http://far.net/", '<a HREF = "https://u@Via_Name/z">far</a> farm.net'),
        (3, "http://says.net/", "see bad.info"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    trusted, blocked = (spark.createDataFrame([(h,)], "host string") for h in ("good.org", "bad.info"))
    edges = {(r.src, r.dst, r.n) for r in url_filter.host_edges(table, blocked).collect()}
    assert edges == {("farm.net", "bad.info", 1), ("farm.net", "10.0.0.7", 1), ("far.net", "via_name", 1), ("far.net", "farm.net", 1), ("says.net", "bad.info", 1)}
    assert not any(r.is_kept for r in url_filter.filter_urls(table, trusted, blocked).collect())


def test_farms_are_found_in_a_graph_of_any_size(spark):
    rng = random.Random(4)
    n = 1500
    names = [f"h{i}.net" for i in range(n)]
    bad, farm, fine = names[: n // 3], names[n // 3 : n // 2], names[n // 2 :]
    rows = [(i, f"http://{h}/", " ".join(rng.sample(fine if h in fine else bad, 5))) for i, h in enumerate(names)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    trusted, blocked = (spark.createDataFrame([(h,) for h in part], "host string") for part in (fine[:100], bad))
    kept = {r.host: r.is_kept for r in url_filter.filter_urls(table, trusted, blocked).collect()}
    assert not any(kept[h] for h in bad + farm) and all(kept[h] for h in fine)


@pytest.mark.parametrize("n", [50, 400])
def test_linkers_are_rejected_however_many_seeds_there_are(spark, n):
    rows = [(i, f"http://l{i}.net/", f"<a href='http://bad{i}.info/'>x</a>") for i in range(n)] + [(-1, "http://fine.org/", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    trusted, blocked = spark.createDataFrame([("fine.org",)], "host string"), spark.createDataFrame([(f"bad{i}.info",) for i in range(n)], "host string")
    assert {r.host for r in url_filter.filter_urls(table, trusted, blocked).where("is_kept").collect()} == {"fine.org"}


def test_sites(spark):
    names = ["a.b.example.com", "b.example.com", "example.com", "x.co.uk", "localhost", "10.0.0.1", "w.xn--bcher-kva.xn--p1ai", None]
    got = spark.createDataFrame([(n,) for n in names], "h string").select(url_filter.site_of(F.col("h"), ("example.com", "co.uk"))).collect()
    assert [r[0] for r in got] == ["b.example.com", "b.example.com", "example.com", "x.co.uk", None, None, "xn--bcher-kva.xn--p1ai", None]


def test_crawled_pages_change_their_verdict_through_edges(spark):
    """On the given pages: edges exist, hosts that are no seeds are rejected by what reaches them, and one that trust reaches is saved."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seeds = [url_filter.seed_sites(pages, listed, queries.SUFFIXES) for listed in (queries.TRUSTED, queries.BLOCKED)]
    assert url_filter.host_edges(pages, seeds[0].union(seeds[1]), queries.SUFFIXES).count() > 0
    blocked = {r.host for r in seeds[1].collect()}
    judged = {r.host: r.is_kept for r in url_filter.filter_urls(pages, *seeds, suffixes=queries.SUFFIXES).collect()}
    gone = {h for h, kept in judged.items() if not kept}
    reached = gone - blocked
    assert reached and all(h.split(".", 1)[1] in blocked for h in reached)
    assert gone == {h for h in judged if h in blocked or h.split(".", 1)[1] in blocked}
    saved = sorted(reached)[0]
    trusted = seeds[0].union(spark.createDataFrame([(saved,)], "host string"))
    row = url_filter.filter_urls(pages, trusted, seeds[1], suffixes=queries.SUFFIXES).where(F.col("host") == saved).first()
    assert row.distrust > 0 and row.is_kept


def vectors(seed=1, n=1500, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    near = base[: n // 5] + rng.normal(size=(n // 5, width)) * rng.uniform(0.02, 0.3, (n // 5, 1))
    return np.concatenate((base, near, base[:40]))


def brute_groups(x, threshold):
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
        a, b = i, j
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
    return root


def test_forest_finds_what_all_pairs_find(spark):
    x = vectors()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in embed_dedup.near_duplicates(table, leaf=64, cell=200).collect()}
    want = brute_groups(x, embed_dedup.THRESHOLD)
    linked = [i for i, r in enumerate(want) if r != i]
    assert len(linked) > 150 and len(got) == len(x)
    assert sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
    assert all(got[i] == i for i, r in enumerate(want) if r == i)


def test_trees_are_added_for_a_hot_cluster(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    own = unit(rng.normal(size=(1200, 64)))
    near = unit(0.8 * own[:300] + 0.6 * unit(rng.normal(size=(300, 64))))
    x = np.sqrt(0.85) * unit(rng.normal(size=64)) + np.sqrt(0.15) * np.concatenate((own, near))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in embed_dedup.near_duplicates(table, trees=2, leaf=16, cell=400).collect()}
    want = brute_groups(x, embed_dedup.THRESHOLD)
    linked = [i for i, r in enumerate(want) if r != i]
    assert len(linked) > 200 and sum(got[i] == want[i] for i in linked) >= 0.85 * len(linked)


@pytest.mark.parametrize("trees, leaf, spill, cell", [(1, 8, 0.0, 300), (6, 64, 0.05, 200)])
def test_no_link_is_lost_whatever_the_trees_find(spark, trees, leaf, spill, cell):
    """Hot cluster, isotropic vectors, chains and tight copies: exactly the groups of all pairs."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    own = unit(rng.normal(size=(700, 64)))
    near = unit(0.8 * own[:200] + 0.6 * unit(rng.normal(size=(200, 64))))
    hot = np.sqrt(0.85) * unit(rng.normal(size=64)) + np.sqrt(0.15) * np.concatenate((own, near))
    turn = np.arange(60)[:, None] * 0.3
    chain = np.concatenate((np.cos(turn), np.sin(turn), np.zeros((60, 62))), axis=1)[::7]  # far apart, closed by what follows
    steps = np.concatenate((np.cos(turn), np.sin(turn), np.zeros((60, 62))), axis=1)
    copies = unit(np.repeat(unit(rng.normal(size=(20, 64))), 15, axis=0) + 0.02 * rng.normal(size=(300, 64)))
    x = np.concatenate((hot, chain, vectors(width=64), copies, steps))
    order = rng.permutation(len(x))
    table = spark.createDataFrame([(i, x[k].tolist()) for i, k in enumerate(order)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in embed_dedup.near_duplicates(table, trees=trees, leaf=leaf, spill=spill, cell=cell).collect()}
    want = brute_groups(x[order], embed_dedup.THRESHOLD)
    assert len({r for i, r in enumerate(want) if r != i}) > 100
    assert [got[i] for i in range(len(x))] == want


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [("1", [1.0, 0.0]), ("2", [2.0, 0.0]), ("3", None), ("4", [0.0, 0.0]), ("5", [1.0]), ("6", [nan, 1.0]), ("7", [None, 1.0]), ("8", []), (None, [1.0, 0.0]), ("9", [0.0, 1.0]), ("1", [1.0, 0.0]), ("10", [0.0, 5.0]), ("11", [-1.0, 0.0]), ("12", [7.0]), ("13", [-0.0, 3.0]), ("14", [1e30, 1e20]), ("one", [0.0, 1.0]), ("15", [3.0, 4.0]), ("2", [4.0, 3.0])]
    table = spark.createDataFrame([(*r, "x", "y", "z", 0, 1) for r in rows], "vec_id string, embedding array<float>, node string, tree string, label string, width int, `a.b` int")
    for given in (table, table.where("vec_id rlike '^[0-9]*$' or vec_id is null").withColumn("vec_id", F.col("vec_id").cast("int"))):
        got = sorted((r.vec_id, r.group_id, r.is_kept) for r in embed_dedup.near_duplicates(given).collect())
        want = {2: 1, 10: 9, 12: 5, 13: 9, 14: 1, 15: 1}  # 15 is near the other vector of 2
        assert got == [(i, want.get(i, i), i not in want) for i in range(1, 16)]
    assert embed_dedup.near_duplicates(table.limit(0)).count() == 0
    many = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(2000)], "vec_id long, embedding array<double>")
    assert {r.group_id for r in embed_dedup.near_duplicates(many, leaf=16, cell=50).collect()} == {0, 1}
    close = spark.createDataFrame([(i, [1.0, i * 1e-7]) for i in range(700)], "vec_id long, embedding array<double>")
    assert {r.group_id for r in embed_dedup.near_duplicates(close, leaf=4, cell=100).collect()} == {0}
    rng = np.random.default_rng(6)
    dense = 1 + 0.1 * rng.normal(size=(600, 24))  # one group, far larger than a leaf
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)], "vec_id long, embedding array<double>")
    assert {r.group_id for r in embed_dedup.near_duplicates(table, leaf=32, cell=200).collect()} == {0}


def test_pairs_in_doubt_are_verified(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = np.where(np.arange(300) % 2, 0.9502, 0.9498)[:, None]
    x = np.concatenate((a, cosine * a + np.sqrt(1 - cosine**2) * b))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.group_id for r in embed_dedup.near_duplicates(table, leaf=1000).collect()}
    assert all(got[300 + i] == (i if i % 2 else 300 + i) for i in range(300))


def test_components_keep_self_edges(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 3), (None, 4), (5, 5), (3, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges, shared_dir(spark)).collect()} == {(1, 1), (2, 2), (3, 2), (5, 5), (7, 2)}
