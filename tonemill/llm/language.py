"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character 3-grams (A-Z and other letters lower-cased); a linear layer
and a softmax give the languages' shares. Embeddings and layer are trained by stochastic gradient descent in numpy, on a
bounded sample of labelled documents (the parameter `sample`) and on short pieces of them. On rows kept aside, a
temperature is fitted so that scores are probabilities, and the least score is found at which accepted rows are right as
often as `accuracy`; rows below it are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import crc_mod, prepare
from tonemill.llm.hashed import blocks, counts_of, labelled_sample

SAMPLE, DIMS, GRAM, WIDTH, EPOCHS, BATCH, RATE, ACCURACY = 4000, 4096, 3, 16, 12, 32, 0.5, 0.99
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, WIDTH), np.float32))
    layer: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (mean_rows(counts) @ self.embedding @ self.layer + self.bias).astype(np.float64)

    def shares(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def mean_rows(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def thinned(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Counts of a few n-grams drawn from each row, as a short text would have."""
    share = np.minimum(1.0, rng.integers(5, 60, (len(counts), 1)) / np.maximum(counts.sum(1, keepdims=True), 1))
    return rng.binomial(counts.astype(np.int64), share).astype(np.float32)


def fit_arrays(counts: np.ndarray, names: list[str], accuracy: float = ACCURACY) -> Model:
    """A model of counts and language names. One row in ten is kept aside for temperature and rejection."""
    languages = sorted(set(names))
    if not languages:
        return Model()
    y = np.array([languages.index(x) for x in names])
    rng = np.random.default_rng(23)
    order = rng.permutation(len(y))
    aside, train = order[: len(y) // 10], order[len(y) // 10 :]
    k = len(languages)
    model = Model(languages, rng.uniform(-1, 1, (DIMS, WIDTH)).astype(np.float32) / WIDTH, np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32))
    steps, step = EPOCHS * max(1, -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for low in range(0, len(train), BATCH):
            rows = train[low : low + BATCH]
            x = mean_rows(np.concatenate([counts[rows], thinned(counts[rows], rng)]))
            target = np.concatenate([y[rows], y[rows]])
            hidden = x @ model.embedding
            error = softmax(hidden @ model.layer + model.bias)
            error[np.arange(len(target)), target] -= 1
            error = (error / len(target)).astype(np.float32)
            rate = RATE * (1 - step / steps)
            down = error @ model.layer.T
            model.layer -= rate * 8 * (hidden.T @ error)
            model.bias -= rate * error.sum(0) * 0.1
            model.embedding -= rate * DIMS / 8 * (x.T @ down)
            step += 1
    test = aside if len(aside) else train
    mixed = np.concatenate([counts[test], thinned(counts[test], rng)])
    truth, z = np.concatenate([y[test], y[test]]), model.logits(mixed)
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    shares = softmax(z / model.temperature)
    best, right = shares.max(1), shares.argmax(1) == truth
    down = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= accuracy)
    model.least = float(best[down[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` documents with a language whose crc32(doc_id) mod 4 is not 2."""
    prepare(docs.sparkSession)
    known = docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", F.col("lang").alias("label"))
    counts, names = labelled_sample(docs, known, sample, DIMS, GRAM, True)
    return fit_arrays(counts, names)


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of docs.

    A text that is null or has no letter, or any text if no language was learned, is `und` with score 0 and rejected. Ties go
    to the first language by name. Repeated rows get the same; extra columns are not read; an empty table gives an empty
    result; a null id is held_out null.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, texts in blocks(batch, 1):
                some = np.array([bool(own.languages) and t is not None and any(map(str.isalpha, t)) for t in texts])
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if some.any():
                    shares = np.round(own.shares(counts_of([t.lower().encode() for t, s in zip(texts, some, strict=True) if s], DIMS, GRAM)), 6)
                    best = iter(shares.argmax(1).tolist())
                    names = [own.languages[next(best)] if s else UNKNOWN for s in some]
                    scores[some] = shares.max(1)
                rejected = ~some | (scores < round(own.least, 6))
                yield pa.record_batch([batch.column(0).slice(low, len(texts)), pa.array(names), pa.array(scores), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
