"""Benchmark decontamination by spaced seeds.

Words are lower-cased and parted at white space and ASCII punctuation. Each mask names positions of a short span; the
words between them are ignored, so a substituted word there does not hide a match. An item of 13 words or more leaks if in some
window of 13 of its words at least three in four agree with a document's words in a row; an item of 8 to 12 words if that holds
for the whole of it; a shorter one, where a substitution would leave too little to go by, if it occurs word by word. The
masks miss no such window (a test tries all substitutions for all lengths).

One pass over the documents keeps the segments around words whose masked hash is in a bit map of all the benchmark's; the map
has a fixed number of bits a seed, up to a stated size. The segments (no more than the passages that look like the benchmark)
are cut, and joined with the seeds, which are broadcast in sorted blocks of bounded size. Every hit is verified word by word in
the windows that contain it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import _STEP, Words, cut, gram_hashes, hash_words, maybe_broadcast, mix, prepare, row_key, text_arrays, without_rows

WINDOW, NUMERATOR, DENOMINATOR, LEAST_WORDS = 13, 3, 4, 8
#: By number: masks for items of LEAST_WORDS or more; then whole items of 1, 2, ... words.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 2, 5), (0, 2, 5, 6), *(tuple(range(n)) for n in range(1, LEAST_WORDS)))
SPACED = 4
#: Words of the benchmark whose seeds are broadcast at a time (20 bytes a word and mask).
BLOCK_WORDS = 200_000
#: Bits of the map for each seed, and the logarithms of its least and largest size in bits (128 KB to 32 MB).
SEED_BITS, LEAST_BITS, MOST_BITS = 256, 20, 28
#: Hits verified at once.
CHUNK = 50_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(33, 128) if not chr(i).isalnum()]] = 32


def plain_words(column: pa.Array) -> Words:
    body, rows = text_arrays(pc.utf8_lower(column))
    return Words(_FOLD[body], rows)


def window_of(length: int) -> tuple[int, int]:
    """(words of a window, least that agree) of an item of so many words."""
    size = min(WINDOW, length)
    return size, -(-NUMERATOR * size // DENOMINATOR) if length >= LEAST_WORDS else size


def masks_of(lengths: np.ndarray) -> tuple[int, ...]:
    """The numbers of the masks that items of these lengths need."""
    short = sorted({int(n) for n in lengths if 0 < n < LEAST_WORDS})
    return (*(range(SPACED) if (lengths >= LEAST_WORDS).any() else ()), *(SPACED + n - 1 for n in short))


def seeds(hashes: np.ndarray, number: int) -> np.ndarray:
    """The masked hash at each word from which the mask's span fits."""
    mask = MASKS[number]
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for at in mask:
        out *= _STEP
        out += hashes[at : at + n]
    return mix(out)


@dataclass
class Bits:
    """A map of the benchmark's seeds: each sets two bits."""

    words: np.ndarray
    masks: tuple[int, ...] = ()

    def places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.uint64(64 * len(self.words) - 1)
        return key & most, (key >> np.uint64(32)) & most

    def add(self, key: np.ndarray) -> None:
        for place in self.places(key):
            np.bitwise_or.at(self.words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))

    def has(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for place in self.places(key):
            out &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


@dataclass
class Block:
    """Items' words, and their seeds in order: the item's number and the word of each."""

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    masks: tuple[int, ...]
    key: np.ndarray
    item: np.ndarray
    at: np.ndarray


def block_of(ids: list[int], texts: list[str | None]) -> Block:
    words = plain_words(pa.array(texts, pa.string()))
    hashes, row, n = hash_words(words), words.row_of(), np.diff(words.first)
    masks = masks_of(n)
    keys, items, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number in masks:
        mask, key = MASKS[number], seeds(hashes, number)
        inside = row[: len(key)] == row[mask[-1] :]
        length = n[row[: len(key)]]
        inside = np.flatnonzero(inside & (length >= LEAST_WORDS if number < SPACED else length == len(mask)))
        keys.append(key[inside])
        items.append(row[inside])
        ats.append(inside - words.first[row[inside]])
    key, item, at = (np.concatenate(x) for x in (keys, items, ats))
    order = np.argsort(key, kind="stable")
    return Block(np.array(ids, np.int64), words.first, hashes, masks, key[order], item[order], at[order])


def hits(block: Block, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(mask, word of the document, item, word of the item) of equal masked hashes, some at a time.

    Words whose surroundings, as far as any window reaches, are those of an earlier one are left out: they agree with the
    same words of the same items. So a text that repeats one word has few hits, however long it is.
    """
    wide = np.concatenate([np.zeros(WINDOW, np.uint64), hashes, np.zeros(2 * WINDOW, np.uint64)])
    around = gram_hashes(wide, 2 * WINDOW + WINDOW // 2)
    for number in block.masks:
        key = seeds(hashes, number)
        low, high = np.searchsorted(block.key, key), np.searchsorted(block.key, key, side="right")
        at = np.flatnonzero(high > low)
        _, fresh = np.unique(around[at], return_index=True)
        at = at[np.sort(fresh)]
        each = (high - low)[at]
        ends = np.cumsum(each)
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK)))
            part, count = at[begin:stop], each[begin:stop]
            place = np.repeat(part, count)
            entry = np.repeat(low[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            yield number, place, block.item[entry], block.at[entry]
            begin = stop


def verified(block: Block, hashes: np.ndarray, number: int, place: np.ndarray, item: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, agreeing words, first word, last word + 1 in the document) of the best window around each hit that leaks."""
    span, out = MASKS[number][-1] + 1, []
    length = block.first[item + 1] - block.first[item]
    for size in np.unique(np.minimum(length, WINDOW)).tolist():
        some = np.flatnonzero(np.minimum(length, WINDOW) == size)
        _, need = window_of(size)
        p, i, a, n = place[some, None], item[some], at[some, None], length[some, None]
        step = np.arange(span - size, size)[None, :]
        inside = (a + step >= 0) & (a + step < n) & (p + step >= 0) & (p + step < len(hashes))
        own = block.words[np.clip(block.first[i][:, None] + a + step, 0, len(block.words) - 1)]
        same = inside & (own == hashes[np.clip(p + step, 0, len(hashes) - 1)])
        total = lambda x: (s := np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)], axis=1))[:, size:] - s[:, :-size]  # noqa: B023, E731
        agree = np.where(total(inside) == size, total(same), -1)
        best = agree.argmax(axis=1)
        most = agree[np.arange(len(best)), best]
        for k in np.flatnonzero(most >= need).tolist():
            low = int(p[k, 0]) + span - size + int(best[k])
            out.append((int(i[k]), int(most[k]), low, low + size))
    return out


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about so many words, a block at a time on the driver."""
    own = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = own.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    blocks = -(-total // block_words)
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield block_of([r["item_id"] for r in rows], [r["text"] for r in rows])


def segments_of(docs: DataFrame, bits: Bits) -> DataFrame:
    """doc_id, h, start, words: runs of words of a document that lie as near to a likely seed as any window reaches."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            words = plain_words(batch.column(2))
            hashes, row = hash_words(words), words.row_of()
            cover = np.zeros(len(hashes) + 1, np.int64)
            for number in own.masks:
                span = MASKS[number][-1] + 1
                likely = np.flatnonzero(own.has(seeds(hashes, number)))
                likely = likely[row[likely] == row[likely + span - 1]]
                np.add.at(cover, np.maximum(likely - WINDOW, words.first[row[likely]]), 1)
                np.add.at(cover, np.minimum(likely + span + WINDOW, words.first[row[likely] + 1]), -1)
            inside = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            edge = np.flatnonzero(np.append(True, (np.diff(inside) > 1) | (np.diff(row[inside]) > 0)))[: len(inside)]
            low, high = inside[edge], inside[np.append(edge[1:], len(inside))[: len(edge)] - 1] + 1
            of = pa.array(row[low])
            blobs = [hashes[i:j].tobytes() for i, j in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(low - words.first[row[low]]), pa.array(blobs, pa.binary())], ["doc_id", "h", "start", "words"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, start long, words binary")


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows = []
            for d, h, start, words in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                best: dict[int, tuple[int, int, int]] = {}
                hashes = np.frombuffer(words, np.uint64)
                for hit in hits(block, hashes):
                    for item, agree, low, high in verified(block, hashes, *hit):
                        if item not in best or (agree, -low) > (best[item][0], -best[item][1]):
                            best[item] = (agree, low, high)
                rows += [(d, h, int(block.ids[item]), agree, start + low, start + high) for item, (agree, low, high) in best.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "item_id", "agree", "first_word", "end_word"])

    return search


def _found(docs: DataFrame, benchmark: DataFrame, text: str, doc_id: str, block_words: int) -> DataFrame:
    """leaks() with h, the hash of the text by which row_key() tells rows apart."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(text).alias("h"), F.col(text).alias("text"))
    schema = "doc_id long, h long, item_id long, agree long, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    number = sum(len(b.key) for b in blocks_of(benchmark, block_words))
    if not number:
        return out
    size = min(MOST_BITS, max(LEAST_BITS, (SEED_BITS * number - 1).bit_length()))
    bits = Bits(np.zeros(1 << (size - 6), np.uint64))
    for block in blocks_of(benchmark, block_words):
        bits.add(block.key)
        bits.masks = tuple(sorted({*bits.masks, *block.masks}))
    segments = cut(segments_of(docs, bits))
    for block in blocks_of(benchmark, block_words):
        out = out.unionByName(cut(segments.mapInArrow(_searcher(spark.sparkContext.broadcast(block)), schema)))
    best = F.max_by(F.struct("agree", "first_word", "end_word"), F.struct("agree", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "h", "item_id", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, agree, first_word, end_word: the best verified window (of equal ones the first) of each document and item
    that it leaks, by the document's words."""
    return _found(docs, benchmark, text, doc_id, block_words).drop("h")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (in order; empty if clean): one row per row of docs.

    Rows are told apart by id and text: rows that agree in both share their result, a null id is as good as any. Null and empty
    texts are clean, and so are items of null id or without words. Whole texts are searched, however long. Empty tables give
    clean or empty results; extra columns are not read.
    """
    found = _found(docs, benchmark, "text", "doc_id", BLOCK_WORDS)
    found = found.groupBy(F.col("doc_id").alias("id"), "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("own_h"))
    out = own.join(maybe_broadcast(cut(found)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h")), "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows that leak an item, by the rules of contaminated()."""
    return without_rows(docs, _found(docs, benchmark, "text", "doc_id", BLOCK_WORDS).select("doc_id", "h"))
