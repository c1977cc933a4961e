"""Exact deduplication by counting quotient filters.

Each partition builds one filter a block over its 64-bit fingerprints: the quotient (high bits) says where a run
stands, the run keeps the remainders (the other bits) in order, and a counter stands beside each. As quotient and
remainder together are the whole fingerprint, filters merge without loss: quotient range by quotient range, the runs of sorted
remainders are brought into one order and equal ones add their counts. Only documents whose fingerprint has a count above one
are read again, and grouped by their bytes, pre-aggregated in each partition, so that a group with a third of all rows is one
row a partition when it moves.

A filter holds a bit a quotient (occupied), a bit an entry (last of its run), the remainders in just as many bits as they have,
and a byte a counter, with larger counts in a list: about seven to eight bytes an entry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import bucket_count, cut, maybe_broadcast, prepare, row_key, without_rows

HEAD = struct.Struct("<IBBI")
#: Fingerprints of a block of all filters; quotients merged at a time; copies of a text from which its group is broadcast (there
#: are at most rows / HOT_GROUP of those).
BLOCK_PRINTS, RANGE, HOT_GROUP = 2_000_000, 1 << 14, 100_000
MANY = 255


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, end to end."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(blob: bytes, first: int, last: int, width: int) -> np.ndarray:
    """Values first to last (not included) of pack_bits()."""
    if last <= first or not width:
        return np.zeros(max(0, last - first), np.uint64)
    low = first * width // 8
    raw = np.unpackbits(np.frombuffer(blob, np.uint8)[low : (last * width + 7) // 8], bitorder="little")
    bits = np.zeros((last - first, 64), np.uint8)
    begin = first * width - 8 * low
    bits[:, :width] = raw[begin : begin + (last - first) * width].reshape(-1, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


class Filter:
    """A counting quotient filter over fingerprints that share their first `skip` bits."""

    def __init__(self, n: int, q: int, skip: int, occupied: np.ndarray, ends: np.ndarray, remainders: bytes, counts: np.ndarray, many: np.ndarray):
        self.n, self.q, self.skip, self.remainders = n, q, skip, remainders
        self.occupied, self.ends, self.counts, self.many = occupied, ends, counts, many
        last = np.flatnonzero(ends) + 1
        #: the first entry of each quotient's run, and the number of entries
        self.run = np.zeros((1 << q) + 1, np.int64)
        self.run[1:][occupied] = np.diff(last, prepend=0)
        np.cumsum(self.run, out=self.run)

    @property
    def width(self) -> int:
        return 64 - self.skip - self.q

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, skip: int, q: int | None = None) -> Filter:
        """Of distinct sorted fingerprints and their counts; by default about as many quotients as entries."""
        q = min(64 - skip, max(1, (len(prints) - 1).bit_length())) if q is None else q
        width = 64 - skip - q
        quotient = ((prints >> np.uint64(width)) & np.uint64((1 << q) - 1)).astype(np.int64) if width < 64 else np.zeros(len(prints), np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.append(quotient[1:] != quotient[:-1], True)[: len(prints)]
        high = counts >= MANY
        return cls(len(prints), q, skip, occupied, ends, pack_bits(prints, width), np.where(high, MANY, counts).astype(np.uint8), counts[high].astype("<u8"))

    def pack(self) -> bytes:
        parts = (np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(), self.remainders, self.counts.tobytes(), self.many.tobytes())
        return HEAD.pack(self.n, self.q, self.skip, len(self.many)) + b"".join(parts)

    @classmethod
    def unpack(cls, blob: bytes) -> Filter:
        n, q, skip, many = HEAD.unpack_from(blob)
        sizes = [((1 << q) + 7) // 8, (n + 7) // 8, (n * (64 - skip - q) + 7) // 8, n, 8 * many]
        at = np.cumsum([HEAD.size, *sizes])
        parts = [blob[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        bits = lambda x, k: np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool)
        return cls(n, q, skip, bits(parts[0], 1 << q), bits(parts[1], n), parts[2], np.frombuffer(parts[3], np.uint8), np.frombuffer(parts[4], "<u8"))

    def entries(self, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints without their block's bits, in order, and counts, of the quotients from low to high (not included)."""
        high = 1 << self.q if high is None else high
        first, last = int(self.run[low]), int(self.run[high])
        quotient = np.repeat(np.arange(low, high, dtype=np.uint64), np.diff(self.run[low : high + 1]))
        prints = (quotient << np.uint64(self.width) if self.width < 64 else quotient * np.uint64(0)) | unpack_bits(self.remainders, first, last, self.width)
        counts = self.counts[first:last].astype(np.int64)
        if len(self.many):
            before = int(np.count_nonzero(self.counts[:first] == MANY))
            large = np.flatnonzero(counts == MANY)
            counts[large] = self.many[before : before + len(large)]
        return prints, counts

    def prints(self, block: int) -> np.ndarray:
        return self.entries()[0] | (np.uint64(block) << np.uint64(64 - self.skip) if self.skip else np.uint64(0))


def merge_filters(parts: list[Filter]) -> Filter:
    """The union of a block's filters, as a filter; counts of equal fingerprints add up.

    Quotients of the shortest length are gone through in ranges, so that only a range's remainders are unpacked at a time.
    """
    q, skip = min(p.q for p in parts), parts[0].skip
    prints, counts = [], []
    for low in range(0, 1 << q, RANGE):
        high = min(1 << q, low + RANGE)
        own = [p.entries(low << (p.q - q), high << (p.q - q)) for p in parts]
        value, count = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
        prints.append(value[first])
        counts.append(np.add.reduceat(count, first) if len(first) else count)
    return Filter.build(np.concatenate(prints), np.concatenate(counts), skip)


def repeated_prints(prints: DataFrame) -> DataFrame:
    """(fp, n): the fingerprints (column fp of a table that is cut) that occur more than once, by merged filters."""
    blocks = max(bucket_count(prints.sparkSession), -(-prints.count() // BLOCK_PRINTS))
    skip = max(1, (blocks - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(own), return_counts=True)
            of = (values >> np.uint64(64 - skip)).astype(np.int64)
            edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            ends = np.append(edge[1:], len(of))
            blobs = [Filter.build(values[i:j], counts[i:j], skip).pack() for i, j in zip(edge.tolist(), ends.tolist(), strict=True)]
            return pa.record_batch([pa.array(of[edge]), pa.array(blobs, pa.binary())], ["block", "filter"])

        for batch in batches:
            own.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held > BLOCK_PRINTS:
                yield flush()
                own, held = [], 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        whole = merge_filters([Filter.unpack(b) for b in group.column("filter").to_pylist()])
        counts = whole.entries()[1]
        more = counts > 1
        return pa.table({"fp": whole.prints(group.column("block")[0].as_py())[more].view(np.int64), "n": counts[more]})

    filters = prints.select("fp").mapInArrow(build, "block long, filter binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def _decided(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """exact_groups() with h, the hash of the text as it is."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), row_key(text).alias("h"), normalised(F.col(text)).alias("norm"))
    print_, sha = F.xxhash64("norm"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    digests = cut(texts.select("doc_id", "h", print_.alias("fp"), sha.alias("sha")))
    again = cut(repeated_prints(digests)).select(F.col("fp").alias("again"))
    routed = texts.withColumn("fp", print_)
    routed = routed.join(maybe_broadcast(again), routed["fp"] == again["again"], "left_semi")
    groups = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.select("fp", sha.alias("sha"), "keep_id", "group_size"))
    # a fingerprint that two texts share leaves singles among the groups, which these joins give their own id and size 1
    hot = maybe_broadcast(cut(groups.where(F.col("group_size") >= HOT_GROUP)))
    rest = digests.join(hot, ["fp", "sha"], "left_anti").join(groups.where(F.col("group_size") < HOT_GROUP), ["fp", "sha"], "left")
    out = rest.unionByName(digests.join(hot, ["fp", "sha"]))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "h", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical after normalised(); whole texts count, however long. Null and empty texts are one group. The
    smallest doc_id stays; rows that repeat it in the group share its decision; rows of null doc_id count, but stay only where
    all of the group are null (keep_id is then null). Extra columns are not read; an empty table gives an empty result.
    """
    return _decided(docs, text, doc_id).drop("h")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows that exact_groups() drops; of rows equal in id and normalised text the one of
    the least text stays (of rows equal in text too any: they differ in other columns at most)."""
    rows = cut(_decided(docs, "text", "doc_id").select("doc_id", "h", "kept", "group_size", "text_sha256"))
    out = without_rows(docs, rows.where("not kept").select("doc_id", "h"))
    twins = rows.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.collect_set("h").alias("hs"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = cut(twins.select("doc_id", F.explode("hs").alias("h")))
    if twins.isEmpty():
        return out
    names = twins.select(F.col("doc_id").alias("twin_id"), F.col("h").alias("twin_h"))
    doubled = out.join(maybe_broadcast(names), out["doc_id"].eqNullSafe(names["twin_id"]) & (F.xxhash64(out["text"]) == names["twin_h"]), "left_semi")
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    one = doubled.select(row.alias("r"), F.col("text").alias("t")).groupBy(F.col("r.doc_id"), normalised(F.col("t")).alias("norm")).agg(F.min_by("r", F.struct("t")).alias("r"))
    return without_rows(out, twins).unionByName(one.select("r.*"))
