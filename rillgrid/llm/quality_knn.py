"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import integer, shared_dir, written

BITS = 12
DIMENSIONS = 64
LABELLED_ROWS = 4000
NEIGHBOURS = 15
SHARPNESS = 4.0
ROWS = 256


def term_weights(counts: np.ndarray, rarity: np.ndarray | None = None) -> np.ndarray:
    """Rows of 1 + ln(count), times the terms' rarity, of length 1; a row without terms stays zero."""
    out = np.log1p(counts, out=counts)
    if rarity is not None:
        out *= rarity
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.where(norm > 0, norm, 1)[:, None]
    return out


class Voter:
    """Terms' rarity, projection to latent space, and the labelled vectors with their labels."""

    def __init__(self, rarity, projection, ids, vectors, labels, prior):
        self.rarity, self.projection, self.ids, self.vectors, self.labels, self.prior = rarity, projection, ids, vectors, labels, prior

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 11) -> Voter:
        """Latent-semantic analysis of the labelled rows by a randomised singular value decomposition."""
        rarity = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)).astype(np.float32) + 1
        terms = term_weights(counts.astype(np.float32), rarity)
        dimensions = min(dimensions, *terms.shape)
        draw = np.random.default_rng(seed).standard_normal((terms.shape[1], dimensions + 16)).astype(np.float32)
        for _ in range(3):
            basis, _ = np.linalg.qr(terms @ draw)
            draw = terms.T @ basis
        _, _, right = np.linalg.svd(draw.T, full_matrices=False)
        projection = np.ascontiguousarray(right[:dimensions].T.astype(np.float32))
        voter = cls(rarity, projection, ids, None, labels.astype(np.float32), float(labels.mean()))
        voter.vectors = voter._latent(terms)
        return voter

    def _latent(self, terms: np.ndarray) -> np.ndarray:
        out = terms @ self.projection
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm > 0, norm, 1)[:, None]

    def vote(self, counts: np.ndarray, ids: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Scores of rows of term counts: the labels of the nearest, weighted by a power of their cosine.

        The cosines to every labelled vector are computed, in blocks. A labelled document has no vote on itself.
        Where no neighbour has a positive cosine the score is the labels' mean. Vectors as near as the last of the nearest share the
        places that are left, so that ties don't depend on any order.
        """
        latent = self._latent(term_weights(counts, self.rarity))
        cosine = latent @ self.vectors.T
        order = np.argsort(self.ids, kind="stable")
        lo, hi = np.searchsorted(self.ids[order], ids, "left"), np.searchsorted(self.ids[order], ids, "right")
        for row in np.flatnonzero(hi > lo):
            cosine[row, order[lo[row] : hi[row]]] = -1
        k = min(neighbours, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        row, near = np.nonzero(cosine >= last)
        tied = cosine[row, near] == last[row, 0]
        ties = np.bincount(row, tied, len(cosine))
        places = (k - (np.bincount(row, minlength=len(cosine)) - ties)) / ties
        weight = np.maximum(cosine[row, near], 0).astype(np.float64) ** SHARPNESS * np.where(tied, places[row], 1)
        total = np.bincount(row, weight, len(cosine))
        return np.where(total > 1e-9, np.bincount(row, weight * self.labels[near], len(cosine)) / np.maximum(total, 1e-9), self.prior)


def _ids(column) -> np.ndarray:
    return K.as_array(column).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = LABELLED_ROWS, bits: int = BITS, dimensions: int = DIMENSIONS) -> Voter | None:
    """Fits the vectors on at most about ``labelled_rows`` labelled rows, chosen by a hash of their id."""
    work = shared_dir(docs.sparkSession)
    known = labels.select(integer("doc_id").alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    share = int(min(1.0, labelled_rows / max(1, known.count())) * 1_000_000)
    chosen = written(known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share), f"{work}/labels")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            rows = []
            for i, j in K.spans(offsets, 1 << 18):
                rows += [zlib.compress(r.tobytes(), 1) for r in K.histograms(data, offsets, i, j, bits).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "counts"])

    texts = docs.select(integer("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id")
    rows = texts.select("id", "label", "text").mapInArrow(count, "id bigint, label double, counts binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("counts", "ascending")])
    if rows.num_rows < 2:
        return None
    counts = np.stack([np.frombuffer(zlib.decompress(c), np.float32) for c in rows["counts"].to_pylist()])
    return Voter.fit(rows["id"].to_numpy(), counts, rows["label"].to_numpy(), dimensions)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS, neighbours: int = NEIGHBOURS, bits: int = BITS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(doc_id, quality_score, is_kept)``, one row per row of ``docs``.

    Texts are vectors of hashed byte-trigram counts over the whole text, projected to the latent space of the
    labelled rows. The score is the similarity-weighted mean label of the ``neighbours`` nearest labelled
    vectors, from exact cosines; is_kept is score >= ``threshold``. The labelled rows are the only bounded sample.

    A text under three bytes, null or empty, has no vector: its score is the labels' mean. Null ids are scored, too;
    repeated ids each by itself, and ids that are no integers as if null. Labels with null parts are left out, several labels of an id are
    averaged. With fewer than two labelled documents every score is null and every row kept. Extra columns are ignored.
    """
    voter = train(docs, labels, label, labelled_rows, bits, dimensions)
    if voter is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(True).alias("is_kept"))
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffer(batch.column("text"))
            ids = _ids(batch.column("id"))
            out = np.zeros(batch.num_rows)
            for i, j in K.spans(offsets, 1 << 20):
                for a in range(i, j, ROWS):
                    b = min(a + ROWS, j)
                    out[a:b] = sent.value.vote(K.histograms(data, offsets, a, b, bits), ids[a:b], neighbours)
            out = np.round(out, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(out >= threshold)], names=["doc_id", "quality_score", "is_kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", integer("doc_id").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, quality_score double, is_kept boolean")
