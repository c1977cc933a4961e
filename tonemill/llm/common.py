"""What the operators of this subpackage share: lineage cuts, column handling, word and shingle hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.session import BROADCAST_ROWS, cut, maybe_broadcast, share_package, shared_folder, table  # noqa: F401

#: ASCII white space: the characters \x20 and \x09-\x0D, at which words end.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def prepare(spark: SparkSession) -> None:
    """Settings for Arrow-fed operators: importable package, Arrow batches that stay small with long texts, and workers, which
    Spark uses again and again, that give the memory of freed arrays back."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared checkpoint folder and reads it again: for wide tables, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session shuffles to; a cluster sets that by the size of its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD1342543DE82EF95)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and where each row starts (one more entry than rows); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    low, high = (int(offsets[0]), int(offsets[-1]))
    body = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return body, offsets - low


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most so many bytes together, or one row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    low = 0
    while low < batch.num_rows:
        high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), most, side="right")))
        yield batch.slice(low, high - low)
        low = high


class Words:
    """The words of a batch of texts: byte ranges in one buffer, and the rows' ranges of words."""

    def __init__(self, body: np.ndarray, rows: np.ndarray):
        self.body, self.rows = body, rows
        white = WHITE[body]
        first = ~white
        first[1:] &= white[:-1]
        inner = rows[:-1][rows[:-1] < len(body)]
        first[inner] = ~white[inner]
        self.start = np.flatnonzero(first)
        last = ~white
        last[:-1] &= white[1:]
        edge = rows[1:][rows[1:] > 0] - 1
        last[edge] = ~white[edge]
        self.end = np.flatnonzero(last) + 1
        #: words [first[i], first[i+1]) belong to row i
        self.first = np.searchsorted(self.start, rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.first))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    body, rows = text_arrays(column)
    if lower and len(body):
        body = body + ((body >= 65) & (body <= 90)).astype(np.uint8) * np.uint8(32)
    return Words(body, rows)


def _powers(n: int, base: int) -> np.ndarray:
    powers = np.full(n, np.uint64(base), dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def hash_words(words: Words, chunk: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial, as the difference of two running sums, in chunks of bounded memory."""
    start, end = words.start, words.end
    out = np.empty(len(start), dtype=np.uint64)
    up = down = np.zeros(0, np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + chunk)))
        low, high = int(start[at]), int(end[to - 1])
        if high - low > len(up):
            up, down = _powers(high - low, int(_BASE)), _powers(high - low, pow(int(_BASE), -1, 1 << 64))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[words.body[low:high]] * up[: high - low], out=sums[1:])
        s = start[at:to] - low
        out[at:to] = (sums[end[at:to] - low] - sums[s]) * down[s]
        at = to
    return mix(out + (end - start).astype(np.uint64) * _STEP)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, by where the first stands; grams across rows are for the caller to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _STEP
        out += hashes[k : k + count]
    return mix(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where grams that stay in their row start, and the number in each row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total) + shift, count


def row_key(text: str = "text") -> Column:
    """The hash that, with the id, tells rows of one id (or of none) and other texts apart."""
    return F.xxhash64(F.col(text))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and row_key() are in gone (doc_id, h); null ids are matched like others."""
    gone = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct())
    return docs.join(maybe_broadcast(gone), docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]), "left_anti")
