"""Importance resampling towards a target distribution: hashed n-gram counts by DuckDB in each partition.

Each task has a DuckDB of its own, which cuts its batches of texts into words, unnests them, makes n-grams by windows, hashes the
distinct ones with a registered function (zlib's crc32) and counts buckets by document. These counts are spilled to Parquet in
the shared folder. Spark merges them to bucket totals of corpus and target, whose number is a parameter, and scores the
documents from the spilled counts; texts are read once. The draw is the Gumbel top-k: exact ranks by a scan over range
partitions, without a task that has all rows.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import cut, pieces, prepare, stored
from tonemill.operators.scan import scanned

#: Runs of digits, A-Z, a-z and all characters beyond ASCII; A-Z is lower-cased in distinct n-grams only.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that one call of DuckDB gets (or one longer text).
BYTES = 4_000_000
BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 10, "2024"


def batch_sql(low: int, high: int, buckets: int) -> str:
    """SQL over batch(r, text): r, n_words, buckets, counts of each text, empty lists where it has no n-gram."""
    gram = lambda n: "w" + "".join(f" || ' ' || lead(w, {k}) OVER p" for k in range(1, n))  # noqa: E731  null beyond the text's end
    runs = " UNION ALL ".join(f"SELECT r, {gram(n)} AS g FROM words" + " WINDOW p AS (PARTITION BY r ORDER BY i)" * (n > 1) for n in range(low, high + 1))
    return rf"""
WITH words AS MATERIALIZED (SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS l FROM batch)),
grams AS MATERIALIZED (SELECT r, g FROM ({runs}) WHERE g IS NOT NULL),
codes AS MATERIALIZED (SELECT g, zlib_crc(translate(g, '{UPPER}', '{UPPER.lower()}')) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM grams)),
found AS (SELECT r, bucket, count(*) AS n FROM grams JOIN codes USING (g) GROUP BY r, bucket),
lists AS (SELECT r, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::INTEGER ORDER BY bucket) AS counts FROM found GROUP BY r),
sizes AS (SELECT r, count(*) AS n_words FROM words GROUP BY r)
SELECT r, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::INTEGER[]) AS counts
FROM batch LEFT JOIN sizes USING (r) LEFT JOIN lists USING (r) ORDER BY r"""


def crc(column) -> pa.Array:
    """zlib's crc32 of each string's UTF-8 bytes."""
    return pa.array([zlib.crc32(g.encode()) for g in column.to_pylist()], pa.uint32())


def database():
    """A DuckDB of one thread with the hash function; beyond its memory it spills to the task's own temporary folder."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": os.path.join(os.environ.get("TMPDIR", "/tmp"), f"duckdb-{os.getpid()}")})
    db.create_function("zlib_crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return db


def bucket_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", low: int = 1, high: int = 1, buckets: int = BUCKETS, most: int = BYTES) -> DataFrame:
    """doc_id, n_words, buckets, counts: one row per row of docs; hashed n-grams of low to high words with their counts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, sql = database(), batch_sql(low, high, buckets)
        try:
            for batch in batches:
                for piece in pieces(batch, 1, most):
                    db.register("batch", pa.table({"r": pa.array(np.arange(piece.num_rows)), "text": piece.column(1)}))
                    got = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    lists = [got.column(c).cast(pa.list_(pa.int32())).combine_chunks() for c in ("buckets", "counts")]
                    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
                    yield pa.record_batch([piece.column(0), got.column("n_words").combine_chunks().cast(pa.int64()), *lists], ["doc_id", "n_words", "buckets", "counts"])
        finally:
            db.close()

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, buckets array<int>, counts array<int>")


def totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows; a task sends as many numbers as there are buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counted.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of add-one shares) by bucket."""
    all_s, all_t, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + k) / ((s + 1.0) * (all_t + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight from spilled counts."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).flatten().to_numpy().astype(np.int64)
            worth = np.concatenate(([0], np.cumsum(n * shared.value[batch.column(2).flatten().to_numpy()])))
            upto = np.concatenate(([0], np.cumsum(n)))
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(upto[ends])), pa.array(np.diff(worth[ends]))], ["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs.

    weight: the sum of the gains of the text's n-grams. score: weight plus Gumbel noise fixed by seed and doc_id. Of the rows
    with at least least_words words, share % (rounded down) of the highest scores are drawn and ranked from 1; rank is null for the
    others. Null and empty texts have no feature and weight 0. Ties go to the smaller doc_id; null ids (whose noise is that of
    an empty id) come last among ties; repeated rows are drawn each for itself, equal ones in any order. Whole texts count,
    however long: a text longer than a batch goes through DuckDB alone, which spills beyond its memory. Other columns of docs are not read; of
    target the column text. Empty docs give an empty result; an empty target counts 0 in each bucket.
    """
    counted = stored(bucket_counts(docs, text, doc_id, low, high, buckets))
    items = bucket_counts(target.withColumn("no id", F.lit(None).cast("long")), "text", "no id", low, high, buckets)
    scores = weighed(counted, gains(totals(counted, buckets), totals(items, buckets)))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    scores = cut(scores.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")))
    able = F.col("n_words") >= least_words
    drawn = share * scores.where(able).count() // 100
    placed = scanned(scores.where(able).drop("n_words"), [], [F.desc("score"), F.asc_nulls_last("doc_id")], number="place")
    placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return placed.unionByName(scores.where(~able).drop("n_words").withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")
