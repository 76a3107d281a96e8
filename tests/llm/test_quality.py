import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillgrid.llm import kernels as K
from rillgrid.llm import langid, quality_knn, quality_rules

from .conftest import DATA, sentence


def junk(rng):
    text = sentence(rng, 60)
    words = text.split(" ")
    return [
        " ".join(w + rng.choice(["***", "&&&", "###"]) for w in words),
        " ".join(w.upper() + "!!" for w in words),
        " | ".join(words),
        " ".join(w for w in words for _ in range(6)),
        "\n".join(["the same line"] * 30),
        "x" * 500,
        "\n- ".join(words),
        "12 34 ... 5 ... 6 ... 7 ... ...",
        "",
        "  ",
        "A... b... c... d... e... f...",
    ]


def test_rules_match_duckdb(spark, odd):
    rng = random.Random(1)
    rows = [(1000 + i, t) for i, t in enumerate([*junk(rng), *(sentence(rng, n) for n in (1, 3, 40, 400)), "one\ntwo\n\nthree", " a  a\na a "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    documents = docs.toArrow()  # noqa: F841
    want = duckdb.connect().execute(quality_rules.duckdb_sql()).fetchall()
    got = [tuple(r) for r in quality_rules.judge(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = {r[0] for r in got if r[1]}
    assert not kept & set(range(1000, 1011)) and {1011, 1012, 1013, 1014} <= kept


def test_any_order_gives_the_same(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(t,) for t in [*junk(rng), *(sentence(rng, 30) for _ in range(5)), "aa aa aaa aaa\naaa  a a", "b " * 40, "c\nc\n" * 30]], "t string")
    docs = quality_rules.counted(docs)
    names = list(quality_rules.RULES)
    ways = [[r[0] for r in docs.select(quality_rules.cascade(None, order).isNull()).collect()] for order in (names, names[::-1])]
    assert ways[0] == ways[1]
    singly = docs.select(*(c.alias(k) for k, c in quality_rules.rule_columns().items())).collect()
    assert [not any(r) for r in singly] == ways[0]


def test_rules_keep_columns(odd, nothing):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() > 0
    want = sorted(str(tuple(r)) for r in odd.where("length(trim(coalesce(text, ''))) > 0 and text <> '###'").collect())
    assert sorted(str(tuple(r)) for r in kept.collect()) == want
    assert quality_rules.keep_good(nothing).count() == 0 and quality_rules.judge(nothing).count() == 0


def test_likelihoods_by_hand():
    rng = random.Random(3)
    table = np.random.default_rng(0).normal(size=(1 << 8, 3)).astype(np.float32)
    texts = ["", "a", "ab", "abc", sentence(rng, 50), None, "é" * 5, sentence(rng, 300)]
    sums, letters = langid.log_likelihoods(pa.array(texts), table)
    for text, got in zip(texts, sums):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        codes = K.trigram_codes(raw, 8) if len(raw) > 2 else np.zeros(0, np.int32)
        assert np.allclose(got, table[codes].astype(np.float64).sum(0), atol=1e-3)
    block, K.BLOCK_BYTES = K.BLOCK_BYTES, 64
    try:
        cut, same = langid.log_likelihoods(pa.array(texts), table)
    finally:
        K.BLOCK_BYTES = block
    assert np.allclose(cut, sums, atol=1e-3) and (same == letters).all()


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    blind = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = blind.select("doc_id").join(langid.identify(blind), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 0").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.lang for r in got]) > 0.95
    assert np.mean([r.is_kept for r in got]) > 0.98


def test_priors_decide_where_texts_do_not(spark):
    rows = [(i, "der die und nicht ist das haus " * 5, "de", "x.example.de") for i in range(40)] + [(100 + i, "the house and the river are not here " * 5, "en", "y.example.com") for i in range(40)]
    rows += [(200, "a b", None, "x.example.de"), (201, "a b", None, "y.example.com"), (202, "a b", None, "new.example.de"), (203, "a b", "de-AT", None)]
    got = {r.doc_id: r.predicted for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_confidence=0.0, evidence=2.0).collect()}
    assert (got[200], got[201], got[202], got[203]) == ("de", "en", "de", "de")


def test_language_of_odd_rows(odd, nothing, spark):
    many = odd.select("doc_id", "text", "lang", "source")
    got = langid.identify(many.unionByName(many.where("lang = 'en'").crossJoin(spark.range(3)).drop("id")))
    assert all(r.predicted == "und" and not r.is_kept for r in got.where("doc_id in (2, 3, 4, 5)").collect())
    assert langid.identify(odd).count() == odd.count()
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns
    assert langid.identify(nothing).count() == 0 and langid.keep_identified(nothing).count() == 0


def test_other_languages_are_unknown(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(6)
    texts = [
        "Сегодня утром в городе пошёл сильный дождь, и люди остались дома читать книги и пить горячий чай. ",
        "Dzisiaj rano w mieście zaczął padać silny deszcz i wszyscy ludzie zostali w domu, żeby czytać książki. ",
        "Tänä aamuna kaupungissa alkoi sataa kovaa ja ihmiset jäivät koteihinsa lukemaan kirjoja ja juomaan teetä. ",
        "今天早上城里下起了大雨，人们都待在家里看书喝茶。",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),
    ]
    other = spark.createDataFrame([(10**9 + i, t * 4, None, None, len(t)) for i, t in enumerate(texts)], docs.schema)
    both = docs.unionByName(other)
    got = langid.identify(both).collect()
    assert all(r.predicted == "und" and not r.is_kept for r in got if r.doc_id >= 10**9)
    assert np.mean([r.is_kept for r in got if r.doc_id < 10**9]) > 0.98
    assert langid.keep_identified(both).where("doc_id >= 1000000000").count() == 0


def test_posteriors_match_brute_force(spark):
    """Every sum of the model anew in NumPy, from trigram counts to confidence, for texts of three languages and five hosts."""
    rng = random.Random(11)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(40)] for lang, letters in (("aa", "abcdefgh"), ("bb", "fghijklm"), ("cc", "klmnopqr"))}
    rows = []
    for i in range(240):
        lang = rng.choice(list(vocabulary))
        text = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([1, 2, 5, 40])))
        rows.append((i, text, rng.choice([lang, lang, lang, lang.upper() + "-X", None, rng.choice(list(vocabulary)), "1?"]), rng.choice([f"h{lang}.aa", f"h{lang}.zz", "Mixed.zz", "nodots", None])))
    rows += [(500, None, "aa", "haa.aa"), (501, "123 4", "bb", None)]
    bits, evidence, strength = 10, 30.0, 3.0
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), bits=bits, evidence=evidence, strength=strength, min_confidence=0.6).collect()}
    languages = sorted(vocabulary)
    tag = lambda t: t[:2].lower() if t and t[0].isalpha() else None
    codes = lambda t: K.trigram_codes(np.frombuffer(t.encode(), np.uint8), bits) if t and len(t) > 2 else np.zeros(0, int)
    table = np.full((1 << bits, 3), 0.1)
    for _, text, lang, _ in rows:
        if tag(lang):
            np.add.at(table[:, languages.index(tag(lang))], codes(text), 1)
    table = np.log((1 - langid.UNSEEN) * table / table.sum(0) * (1 << bits) + langid.UNSEEN)
    letters = np.array([sum(c.isalpha() for c in t or "") for _, t, _, _ in rows])
    text_logs = np.array([table[codes(t)].sum(0) for _, t, _, _ in rows]) / (1 + letters[:, None] / evidence)

    def shares(logs, background):
        p = np.exp(np.column_stack((logs, background)))
        return (p / p.sum(1, keepdims=True))[:, :3]

    first = shares(text_logs - np.log(3), np.full(len(rows), np.log(langid.BACKGROUND))) * (letters > 0)[:, None]
    whole = (first.sum(0) + 1) / (first.sum() + 3)
    seen = np.full((3, 3), 0.5)
    for p, (_, _, lang, _) in zip(first, rows):
        if tag(lang):
            seen[languages.index(tag(lang))] += p
    reliability = np.log(seen / seen.sum(0))
    of = lambda key: {k: sum((p for p, r in zip(first, rows) if key(r) == k), np.zeros(3)) for k in {key(r) for r in rows}}
    host, suffix = (lambda r: (r[3] or "").lower()), (lambda r: (r[3] or "").lower().rpartition(".")[2] if "." in (r[3] or "") else "")
    suffixes = {k: (p + strength * whole) / (p.sum() + strength) for k, p in of(suffix).items()}
    hosts = {k: (p + strength * suffixes[next(suffix(r) for r in rows if host(r) == k)]) / (p.sum() + strength) for k, p in of(host).items()}
    logs = text_logs + np.log([hosts[host(r)] for r in rows]) + np.array([reliability[languages.index(tag(r[2]))] if tag(r[2]) else np.zeros(3) for r in rows])
    want = shares(logs, np.log(langid.BACKGROUND) + np.array([-np.log(3) if tag(r[2]) else 0.0 for r in rows]))
    for r, p, n in zip(rows, want, letters):
        sure = n > 0 and p.max() >= 0.6 and p.max() >= 1 - p.sum()
        assert got[r[0]].confidence == pytest.approx(p.max() if n else 0, abs=2e-4)
        if abs(p.max() - 0.6) > 1e-3:
            assert (got[r[0]].predicted, got[r[0]].is_kept) == ((languages[p.argmax()], True) if sure else ("und", False))
    assert 20 < sum(r.predicted == "und" for r in got.values()) < 200 or len({r.predicted for r in got.values()}) == 4


@pytest.mark.parametrize("n", [70, 300])
def test_every_declared_language_is_learnt(spark, n):
    rng = random.Random(7)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choice(words) for _ in range(60)), f"{chr(97 + k // 26)}{chr(97 + k % 26)}", None) for i in range(3 if k % 5 == 4 else 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.predicted for r in langid.identify(table).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows)


def test_pages_carry_their_evidence(spark):
    page = spark.createDataFrame([(1, "HTTP://A.Example.de:80/x", '<!DOCTYPE html><HTML class=a lang="de-AT"><script>var x="en";</script><p>Guten Tag</p>'), (2, None, None)], "page_id long, url string, html string")
    row = langid.pages_as_documents(page).orderBy("page_id").collect()
    assert row[0].source == "a.example.de" and row[0].lang == "de-AT" and row[0].text.split() == ["Guten", "Tag"] and row[1].source is None


def test_votes_by_hand():
    rng = np.random.default_rng(1)
    counts, labels, ids = rng.poisson(1.0, (60, 256)).astype(np.float32), rng.integers(0, 2, 60).astype(float), np.arange(60)
    voter = quality_knn.Voter.fit(ids, counts.copy(), labels, 16)
    new = rng.poisson(1.0, (20, 256)).astype(np.float32)
    own = np.array([3, 500, *range(700, 718)])
    got = voter.vote(new.copy(), own, 5)
    for row, i, score in zip(new, own, got):
        v = np.log1p(row) * voter.rarity
        v = v / np.linalg.norm(v) @ voter.projection
        cosine = voter.vectors @ (v / np.linalg.norm(v))
        cosine[voter.ids == i] = -1
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0) ** quality_knn.SHARPNESS
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-4)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/labels.parquet")
    seen, hidden = labels.where("doc_id % 4 > 0"), labels.where("doc_id % 4 = 0")
    got = quality_knn.classify(docs, seen).join(hidden, "doc_id").collect()
    good, bad = [r.is_kept for r in got if r.quality == 1], [r.is_kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.4


def test_ties_share_their_places():
    counts = np.zeros((4, 256), np.float32)
    counts[0, 1] = 3
    counts[1:, 2] = 5
    voter = quality_knn.Voter.fit(np.arange(4), counts.copy(), np.array([1.0, 1.0, 0.0, 0.0]), 2)
    new = np.zeros((1, 256), np.float32)
    new[0, 2] = 2
    for k in (1, 2, 3):  # whichever of the three equal vectors come first
        assert voter.vote(new.copy(), np.array([9]), k)[0] == pytest.approx(1 / 3, abs=1e-5)


def test_long_texts_and_ids_that_are_no_integers(spark, very_long):
    labels = spark.createDataFrame([("1", 1), ("4", 0), ("x", 1)], "doc_id string, quality int")
    got = {r.doc_id: r.quality_score for r in quality_knn.classify(very_long.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"))), labels).collect()}
    assert got["2"] > 0.9 and got["1"] <= 0.5 <= got["4"]  # none votes on itself
    assert {r.doc_id for r in langid.identify(very_long).where("is_kept").collect()} >= {1, 2, 5}
    assert quality_rules.judge(very_long).count() == 5


def test_quality_of_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (8, 1), (9, 0), (8, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality_knn.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)
    assert all(r.quality_score is None and r.is_kept for r in quality_knn.classify(odd, labels.limit(0)).collect())
    assert quality_knn.classify(nothing, labels).count() == 0
