"""Quality scores by nearest-neighbour voting in a latent semantic space.

Fit, on a bounded labelled sample (the parameter `sample`): hashed character 3-gram counts, damped, weighted by inverse
document frequency and centred, are reduced to a few dimensions by a randomised singular value decomposition; the
sample's unit vectors and labels are broadcast. Score: each document's whole text is mapped to the same space, its cosine
products with all labelled vectors are taken in blocks of documents, and the nearest ones' labels vote with a power of
their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import crc_mod, prepare
from tonemill.llm.hashed import blocks, counts_of, labelled_sample

SAMPLE, DIMS, GRAM, RANK, NEIGHBOURS, POWER, THRESHOLD = 4000, 4096, 3, 32, 12, 8, 0.3


@dataclass
class Model:
    """What a fit leaves: weights, centre and projection of counts; labelled unit vectors; labels; their mean."""

    idf: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = (weighted(counts, self.idf) - self.centre) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of votes for label 1, with the prior as a small vote of its own; equal similarities go to the earlier label."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = np.rint((self.embed(counts) @ self.vectors.T).astype(np.float64) * 1e5).astype(np.int64)
        n, k = len(self.labels), min(NEIGHBOURS, len(self.labels))
        key = cosine * n - np.arange(n)
        near = np.argpartition(-key, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cosine, near, 1) / 1e5, 0.0) ** POWER
        score = ((weight * self.labels[near]).sum(1) + 1e-3 * self.prior) / (weight.sum(1) + 1e-3)
        return np.round(np.clip(score, 0.0, 1.0), 6)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_arrays(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """A model of counts and 0/1 labels; without rows it scores 0.5 throughout."""
    if not len(counts):
        return Model(np.ones(DIMS, np.float32), np.zeros(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = weighted(counts, idf)
    centre = x.mean(0)
    x = x - centre
    basis = np.random.default_rng(17).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    axes = (basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
    model = Model(idf, centre, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.embed(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows whose crc32(doc_id) mod 5 is not 0; of several labels of an id the least."""
    prepare(docs.sparkSession)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0))
    counts, values = labelled_sample(docs, marks, sample, DIMS, GRAM, False)
    return fit_arrays(counts, np.array(values, float))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null counts as empty text, which scores as its blank bytes do; repeated rows score alike; extra columns are not read; an
    empty table gives an empty result; a null id is held_out null.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in blocks(batch, 1):
                found = shared.value.scores(counts_of([(t or "").encode() for t in texts], DIMS, GRAM))
                yield pa.record_batch([batch.column(0).slice(low, len(texts)), pa.array(found)], ["doc_id", "score"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are predicted 0; all columns as they are, in one pass and without a shuffle."""
    prepare(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.scores(counts_of([(t or "").encode() for t in texts], DIMS, GRAM)) >= THRESHOLD for _, texts in blocks(batch, at)]
            if keep:
                yield batch.filter(pc.fill_null(pa.array(np.concatenate(keep)), False))

    return docs.mapInArrow(run, docs.schema)
