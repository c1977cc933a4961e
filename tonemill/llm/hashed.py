"""Hashed counts of character n-grams over whole texts, and bounded labelled samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import _BYTE, _STEP, cut, mix

#: Rows, and bytes, that are counted at a time.
ROWS, BYTES = 200, 2_000_000


def bucketed(body: np.ndarray, at: np.ndarray, dims: int, n: int) -> np.ndarray:
    value = _BYTE[body]
    hashed = value[at]
    for k in range(1, n):
        hashed = hashed * _STEP + value[at + k]
    return (mix(hashed) % np.uint64(dims)).astype(np.int64)


def counts_of(texts: list[bytes], dims: int, n: int = 3) -> np.ndarray:
    """Rows of counts of n-grams of bytes, hashed to dims columns; a space stands before and after each text.

    Memory is bounded: a run of texts, or a part of a long text, of at most about BYTES bytes is hashed at a time.
    """
    out = np.zeros((len(texts), dims), np.float32)
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= BYTES):
            size += len(texts[high]) + 2
            high += 1
        if high == low + 1:
            body = np.frombuffer(b" " + texts[low] + b" ", np.uint8)
            for i in range(0, len(body) - n + 1, BYTES):
                part = body[i : i + BYTES + n - 1]
                out[low] += np.bincount(bucketed(part, np.arange(len(part) - n + 1), dims, n), minlength=dims)
        else:
            body = np.frombuffer(b" " + b"  ".join(texts[low:high]) + b" ", np.uint8)
            sizes = np.array([len(t) + 2 for t in texts[low:high]], np.int64)
            grams = np.maximum(sizes - n + 1, 0)
            at = np.arange(int(grams.sum())) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(grams) - grams), grams)
            column = bucketed(body, at, dims, n) + np.repeat(np.arange(high - low) * dims, grams)
            out[low:high] = np.bincount(column, minlength=(high - low) * dims).reshape(high - low, dims)
        low = high
    return out


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of a batch, few rows at a time."""
    for low in range(0, batch.num_rows, ROWS):
        yield low, batch.column(column).slice(low, ROWS).to_pylist()


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int, dims: int, n: int, lower: bool) -> tuple[np.ndarray, list]:
    """(counts, labels) of at most `size` documents: of those in labels (doc_id, label), the ones whose ids hash lowest.

    Nulls are left out; of several labels of an id the least holds, and of several texts of an id the one of least counts, so
    that an id is one row however often it repeats. The sample is in order of id.
    """
    known = labels.where("doc_id is not null and label is not null").select("doc_id", "label")
    total, share = known.count(), 0.0
    while True:  # only ids of low hashes are grouped; more of them, if so few ids remain after that
        share = min(1.0, 4 * share or 2 * size / max(1, total))
        low = known if share == 1 else known.where(F.xxhash64("doc_id") < int(share * 2**64) - 2**63)
        chosen = cut(low.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size))
        if share == 1 or chosen.count() >= size:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, texts in blocks(batch, 2):
                counts = counts_of([((t.lower() if lower else t) if t else "").encode() for t in texts], dims, n)
                at = [np.flatnonzero(row) for row in counts]
                yield pa.record_batch(
                    [batch.column(0).slice(low, len(texts)), batch.column(1).slice(low, len(texts)),
                     pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()),
                     pa.array([row[i].astype("<f4").tobytes() for row, i in zip(counts, at, strict=True)], pa.binary())],
                    ["doc_id", "label", "at", "counts"],
                )

    kind = dict(chosen.dtypes)["label"]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    drawn = texts.mapInArrow(run, f"doc_id long, label {kind}, at binary, counts binary")
    rows = drawn.groupBy("doc_id").agg(F.min(F.struct("label", "at", "counts")).alias("r")).orderBy("doc_id").select("r.*").collect()
    x = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return x, [r["label"] for r in rows]
