"""Language identification: text likelihoods fused with declared and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import shared_dir, written

BITS = 14
SAMPLE_PER_LANGUAGE = 1500
EVIDENCE = 200.0
STRENGTH = 20.0
MIN_CONFIDENCE = 0.5
TABLE_FLOATS = 1 << 26  # 256 MB
UNKNOWN = "und"
UNSEEN = 0.1  # share of every language's trigrams that is spread evenly, as all of the background's are
BACKGROUND = 0.01  # prior of a text in no learnt language
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0xC3:0xF5] = True


def primary_subtag(declared: Column) -> Column:
    """'EN-us' and ' en_US ' are 'en'; an empty tag is null."""
    tag = F.lower(F.regexp_extract(F.trim(declared.cast("string")), "^([A-Za-z]{2,8})", 1))
    return F.when(tag != "", tag)


def address_suffix(host: Column) -> Column:
    """The last label of a host with dots, else the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(host.cast("string"), r"\.([A-Za-z]{2,})$", 1)), F.lit(""))


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Documents i to j with bytes a to b; a long document comes in several pieces."""
    for i, j in K.spans(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i == 1 and b - a > K.BLOCK_BYTES:
            for at in range(a, b, K.BLOCK_BYTES):
                yield i, j, at, min(at + K.BLOCK_BYTES, b)
        else:
            yield i, j, a, b


def log_likelihoods(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log p(trigram | language) over the whole of each text, and its number of letters."""
    data, offsets = K.text_buffer(column)
    n, width = len(offsets) - 1, len(table)
    sums, letters = np.zeros((n, table.shape[1])), np.zeros(n, np.int64)
    columns = [np.append(table[:, c], 0).astype(np.float32) for c in range(table.shape[1])]
    bits = width.bit_length() - 1
    for i, j, a, b in _segments(offsets):
        part = data[a : min(b + 2, int(offsets[j]))]
        if a == b:
            continue
        bounds = np.clip(offsets[i : j + 1], a, b) - a
        full = np.flatnonzero(np.diff(bounds))
        starts = bounds[full]
        letters[i + full] += np.add.reduceat(_LETTER[part[: b - a]].astype(np.int32), starts)
        codes = np.full(b - a, width, np.int32)
        if len(part) >= 3:
            got = K.trigram_codes(part, bits)[: b - a]
            codes[: len(got)] = got
        if j - i > 1:  # no trigram runs over a document's end
            ends = bounds[full + 1]
            codes[ends - 1] = width
            codes[np.maximum(ends - 2, starts)] = width
        for c, logs in enumerate(columns):
            sums[i + full, c] += np.add.reduceat(logs[codes], starts, dtype=np.float64)
    return sums, letters


def fit(docs: DataFrame, declared: str = "lang", id_column: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages and log(p(hashed trigram | language) / p(hashed trigram | background)), from texts whose declared language is the label.

    The fit reads at most about ``per_language`` labelled rows of each language, chosen by a hash
    of their id and text (so null and repeated ids are drawn like others), and all rows of a language that has fewer. Every declared language is learnt. The background, for texts in no
    learnt language, has all hashed trigrams alike. The table goes to every executor, so ``bits`` is lowered where it would
    exceed TABLE_FLOATS: more languages then share a coarser hash, and none is left out.
    """
    rows = docs.select(primary_subtag(F.col(declared)).alias("tag"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col("text").cast("string")), F.lit(1_000_000)).alias("h")).where("tag is not null")
    counts = rows.groupBy("tag").count().collect()
    languages = sorted(r["tag"] for r in counts)
    while bits > 8 and len(languages) << bits > TABLE_FLOATS:
        bits -= 1
    if not languages:
        return [], np.zeros((1 << bits, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(r["tag"], int(min(1.0, per_language / r["count"]) * 1_000_000)) for r in counts], "tag string, share int")
    chosen = rows.join(F.broadcast(shares), "tag").where("h < share").select("tag", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            tags = np.array(batch.column("tag").to_pylist(), object)
            for i, j in K.spans(offsets, 1 << 18):
                seen = K.histograms(data, offsets, i, j, bits)
                for tag in set(tags[i:j]):
                    sums[tag] = sums.get(tag, 0.0) + seen[tags[i:j] == tag].sum(0, dtype=np.float64)
        for tag, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([tag]), pa.array([total.tobytes()], pa.binary())], names=["tag", "sums"])

    # a language's sample is in one partition, so that the driver gets one row of each
    table = np.full((1 << bits, len(languages)), 0.1)
    for r in chosen.repartition("tag").mapInArrow(count, "tag string, sums binary").collect():
        table[:, languages.index(r["tag"])] += np.frombuffer(r["sums"])
    table /= table.sum(0, keepdims=True)
    return languages, np.log((1 - UNSEEN) * table * (1 << bits) + UNSEEN).astype(np.float32)


def _tempered(sums: np.ndarray, letters: np.ndarray, evidence: float) -> np.ndarray:
    """Neighbouring trigrams overlap, so the evidence of a text is made to level off at that of ``evidence`` letters."""
    return sums / (1 + letters[:, None] / evidence)


def _softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _of_languages(logs: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Posterior probabilities of the languages; what they lack to 1 is the background's."""
    return _softmax(np.column_stack((logs, background)))[:, :-1]


class LanguageModel:
    """Text likelihoods, declared-tag reliabilities and host priors of one corpus."""

    def __init__(self, languages, table, declared, hosts, evidence):
        self.languages, self.table, self.declared, self.hosts, self.evidence = languages, table, declared, hosts, evidence

    def posterior(self, text, tag, prior) -> tuple[np.ndarray, np.ndarray]:
        """Posterior probabilities, and the texts' numbers of letters."""
        sums, letters = log_likelihoods(text, self.table)
        logs = _tempered(sums, letters, self.evidence) + np.log(prior)
        none = np.zeros(len(self.languages))
        tags = tag.to_pylist()
        logs += np.array([self.declared.get(t, none) for t in tags]).reshape(len(letters), -1)
        # the background has any declared tag alike
        alike = np.array([-np.log(len(self.languages)) if t in self.declared else 0.0 for t in tags])
        return _of_languages(logs, np.log(BACKGROUND) + alike), letters


def _evidence(docs: DataFrame, declared: str, host: str) -> list[Column]:
    source = F.lower(F.col(host).cast("string"))
    return [primary_subtag(F.col(declared)).alias("__tag"), F.coalesce(source, F.lit("")).alias("__host"), address_suffix(source).alias("__suffix")]


def train(docs: DataFrame, work: str, declared: str = "lang", host: str = "source", id_column: str = "doc_id", evidence: float = EVIDENCE, strength: float = STRENGTH, **fitting) -> LanguageModel | None:
    """Fits the text model on a bounded sample, and the priors on every document.

    One pass gives each document's text posterior; grouped aggregation sums them by host,
    address suffix and declared tag. A host's prior is its own counts plus ``strength`` counts of its
    suffix's prior, which in turn has ``strength`` counts of the corpus's. Returns None if no language can be learnt.
    """
    spark = docs.sparkSession
    languages, table = fit(docs, declared, id_column, **fitting)
    if not languages:
        return None
    n = len(languages)
    sent = spark.sparkContext.broadcast(table)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, letters = log_likelihoods(batch.column("text"), sent.value)
            p = _of_languages(_tempered(sums, letters, evidence) - np.log(n), np.full(len(letters), np.log(BACKGROUND)))[letters > 0]
            keys = pa.table({c: batch.column(c) for c in ("__tag", "__host", "__suffix")}).filter(pa.array(letters > 0))
            if not len(p):
                continue
            out = keys.append_column("n", pa.array(np.round(p.sum(1), 9)))
            for k in range(n):
                out = out.append_column(f"p{k}", pa.array(np.round(p[:, k], 9)))
            # summed by key within the batch, so that little is shuffled
            named = ["n", *(f"p{k}" for k in range(n))]
            summed = out.group_by(["__tag", "__host", "__suffix"]).aggregate([(c, "sum") for c in named])
            yield from summed.select(["__tag", "__host", "__suffix", *(f"{c}_sum" for c in named)]).rename_columns(["__tag", "__host", "__suffix", *named]).combine_chunks().to_batches()

    rows = docs.select(*_evidence(docs, declared, host), F.col("text").cast("string").alias("text"))
    schema = "__tag string, __host string, __suffix string, n double, " + ", ".join(f"p{k} double" for k in range(n))
    sums = [F.sum(c).alias(c) for c in ("n", *(f"p{k}" for k in range(n)))]
    counts = written(rows.mapInArrow(expect, schema).groupBy("__tag", "__host", "__suffix").agg(*sums), f"{work}/counts")

    everything = counts.agg(*sums).first()
    whole = (np.array([everything[f"p{k}"] or 0.0 for k in range(n)]) + 1) / ((everything["n"] or 0.0) + n)
    # p(declared tag | language), of the tags that are languages here; any other tag says nothing
    tags = counts.where(F.col("__tag").isin(languages)).groupBy("__tag").agg(*sums).collect()
    seen = np.full((n, n), 0.5)
    for r in tags:
        seen[languages.index(r["__tag"])] += [r[f"p{k}"] for k in range(n)]
    reliability = np.log(seen / seen.sum(0, keepdims=True))
    suffixes = counts.groupBy("__suffix").agg(*sums)
    suffixes = suffixes.select("__suffix", *(((F.col(f"p{k}") + strength * float(whole[k])) / (F.col("n") + strength)).alias(f"q{k}") for k in range(n)))
    hosts = counts.groupBy("__host", "__suffix").agg(*sums).join(suffixes, "__suffix")
    prior = F.array(*((F.col(f"p{k}") + strength * F.col(f"q{k}")) / (F.col("n") + strength) for k in range(n)))
    hosts = written(hosts.select("__host", prior.alias("__prior")), f"{work}/hosts")
    model = LanguageModel(languages, table, {t: reliability[k] for k, t in enumerate(languages)}, hosts, evidence)
    model.whole = whole
    return model


def _judged(docs: DataFrame, model: LanguageModel, declared: str, host: str, min_confidence: float, accepted, keep: list[str], filter_rows: bool) -> DataFrame:
    spark = docs.sparkSession
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("__text"), *_evidence(docs, declared, host))
    # the table of priors is small or large as the corpus has few or many hosts; its true size decides how it is joined
    joined = renamed.join(model.hosts, "__host", "left").drop("__host", "__suffix")
    light = LanguageModel(model.languages, model.table, model.declared, None, model.evidence)
    sent, whole = spark.sparkContext.broadcast(light), model.whole
    allowed = None if accepted is None else {a.lower() for a in accepted}
    fields = [f for f in renamed.schema if f.name[2:].isdigit()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prior = batch.column("__prior")
            values = np.tile(whole, (batch.num_rows, 1))
            known = np.flatnonzero(prior.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                values[known] = prior.flatten().to_numpy().reshape(len(known), -1)
            p, letters = sent.value.posterior(batch.column("__text"), batch.column("__tag"), values)
            best = p.argmax(1)
            sure = (letters > 0) & (p.max(1) >= min_confidence) & (p.max(1) >= 1 - p.sum(1))
            names = np.array([*sent.value.languages, UNKNOWN], object)[np.where(sure, best, len(sent.value.languages))]
            kept = sure if allowed is None else sure & np.isin(names, list(allowed))
            columns = [batch.column(f.name) for f in fields]
            if filter_rows:
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields]).filter(pa.array(kept))
                continue
            confidence = np.round(np.where(letters > 0, p.max(1), 0.0), 6)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(confidence), pa.array(kept)], names=[*(f.name for f in fields), "predicted", "confidence", "is_kept"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    out = fields if filter_rows else [*fields, StructField("predicted", StringType()), StructField("confidence", DoubleType()), StructField("is_kept", BooleanType())]
    judged = joined.mapInArrow(judge, StructType(out))
    return judged.toDF(*keep, *([] if filter_rows else ["predicted", "confidence", "is_kept"]))


def identify(docs: DataFrame, id_column: str = "doc_id", declared: str = "lang", host: str = "source", accepted: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE, **training) -> DataFrame:
    """``(id, predicted, confidence, is_kept)``, one row per document.

    The posterior is proportional to the tempered text likelihood, times p(declared tag | language), times the host's
    smoothed prior. A background in which all trigrams are alike stands for every language that is not learnt. A text without letters
    (null and empty texts too), one that the background explains best, or a posterior under ``min_confidence`` is 'und' and rejected; so is a language outside ``accepted`` where that is given. A null
    declared tag or host says nothing. Rows with null or repeated ids are judged each by itself.
    Ties go to the language first in the alphabet. If no language can be learnt, every row is
    'und'. Extra columns are ignored.
    """
    model = train(docs, shared_dir(docs.sparkSession), declared, host, id_column, **training)
    if model is None:
        return docs.select(F.col(f"`{id_column}`"), F.lit(UNKNOWN).alias("predicted"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_kept"))
    return _judged(docs, model, declared, host, min_confidence, accepted, [id_column], False)


def keep_identified(docs: DataFrame, declared: str = "lang", host: str = "source", id_column: str = "doc_id", accepted: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE, **training) -> DataFrame:
    """The rows that ``identify`` keeps, with all their columns."""
    model = train(docs, shared_dir(docs.sparkSession), declared, host, id_column, **training)
    if model is None:
        return docs.limit(0)
    return _judged(docs, model, declared, host, min_confidence, accepted, docs.columns, True)


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Pages with the tag their markup declares and the host of their address, for ``identify``."""
    tag = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^<>]*>", " ")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select("page_id", text.alias("text"), tag.alias("lang"), F.when(host != "", host).alias("source"))
