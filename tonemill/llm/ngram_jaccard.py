"""Exact similarity join of documents on word shingles, by grouped prefix filtering.

A document is its set of distinct 5-word shingles (64-bit hashes). Two documents link when their Jaccard similarity is
at least 3/4. Shingles are ordered by rarity: first the counted ones of few documents, by hash; then those of many, by count;
then those outside the counted range of hashes. A pair of n and m shingles that links has at least o = ceil(3 (n + m) / 7) in
common, so the first n - o + 1 of the one and the first m - o + 1 of the other share one. So:

1. Documents of equal sets are one class; classes of equal prefix and size are one group.
2. Of the groups that share a prefix shingle, in neighbouring bands of size, the first is the pivot. All groups with one pivot
   (and band) are a bundle: a row for each group and bundle, however many pairs there are. Rare shingles are gathered in packed
   buckets; a shingle of many documents is a grouped minimum, so no task holds all its groups.
3. Bundles are expanded to classes, and large ones dealt out in pairs of blocks of bounded size. In a block, pairs are
   filtered by size and by the distance of their sets' parities, which is never more than that of the sets.
   Of a pair in several bundles only the first bundle thinks of it. What goes on is the classes that are in some pair left.
4. The whole sets of those are dealt out likewise, and each pair is verified exactly, as counts of common bits of the sets
   over the block's shared shingles. A block gives each class's number of links and edges that span its links' components.
5. Components of the edges give each document its class.

No pair is capped or dropped, and none is a row of a table: tables grow with documents and bundles, only the comparisons
inside blocks with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import _STEP, Words, bucket_count, cut, gram_hashes, gram_starts, hash_words, maybe_broadcast, mix, prepare, row_key, without_rows, words_of
from tonemill.llm.components import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 3, 4
#: A shingle of more documents than HEAVY is ordered after all rarer ones. The list of those is broadcast; if it had more than
#: HEAVY_LIST entries (12 bytes each), the least count would be doubled until it fits.
HEAVY, HEAVY_LIST = 32, 1_000_000
#: Prefixes hold the shingles of least hash, so only hashes in this share of all are counted.
COUNTED = np.uint64(int(0.4 * 2**64))
#: Least and most bits of a set's parity; between them two to four a shingle, so that unlike sets of any size are told apart.
LEAST_BITS, MOST_BITS = 1024, 1 << 17
#: Classes, and shingles of them, of a block of a large bundle; prefix shingles of a packed bucket; 64-bit words compared at once.
BLOCK_ROWS, BLOCK_SHINGLES, BUCKET_ENTRIES, AT_ONCE = 1024, 2_000_000, 1_000_000, 4_000_000
#: Classes to be verified, of some hundred bytes each, up to which their table is broadcast.
BROADCAST_WIDE = 100_000
#: For common_shingles(): a share of all documents; the list has at most 2 * (mean shingles) / SHARE entries.
SHARE, LEAST_COPIES = 1e-3, 8
TOKEN = np.uint64((1 << 48) - 1)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, end to end, and where each row's begin (one more entry than rows).

    A row of fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    hashes = hash_words(words)
    at, count = gram_starts(words.first, size)
    grams, rows = gram_hashes(hashes, size)[at] if len(at) else np.zeros(0, np.uint64), np.repeat(np.arange(len(count)), count)
    number = np.diff(words.first)
    for k in range(1, size):
        short = np.flatnonzero(number == k)
        if len(short):
            whole = mix(gram_hashes(hashes, k)[words.first[:-1][short]] + np.uint64(k))
            grams, rows = np.concatenate([grams, whole]), np.concatenate([rows, short])
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1]))[: len(grams)]
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(len(count) + 1))


def common_shingles(docs: DataFrame, size: int = SHINGLE, lower: bool = True, most: int | None = None) -> np.ndarray:
    """Hashes of shingles in a noticeable share of all documents, or in about `most` of them, rarest first.

    Each partition counts all its documents' shingles and reports those of the share or more of its own documents, which
    any shingle of that share of all documents is in some partition; their counts are then added up.
    """

    n_docs = docs.count()
    share = min(SHARE, most / max(n_docs, 1)) if most else SHARE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, total = [], 0, 0

        def flush():
            values, counts = np.unique(np.concatenate(seen), return_counts=True)
            often = counts >= max(LEAST_COPIES, share * total)
            return pa.record_batch([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["shingle", "n"])

        for batch in batches:
            grams, _ = shingle_sets(words_of(batch.column(0), lower=lower), size)
            seen.append(grams)
            held, total = held + len(grams), total + batch.num_rows
            if held > 4_000_000:
                yield flush()
                seen, held, total = [], 0, 0
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = cut(found)
    least = max(LEAST_COPIES, int(share * n_docs / 2))
    rows = found.where(F.col("n") >= least).orderBy("n", "shingle").toPandas()
    return rows["shingle"].to_numpy(np.int64).view(np.uint64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Shingles of a prefix that shares one with that of any linked set."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def lower_prefix_length(n: np.ndarray) -> np.ndarray:
    """Shingles of a prefix that shares one with that of any linked set that is as large or larger."""
    return n - (2 * NUMERATOR * n + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR) + 1


def _band_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-DENOMINATOR * edges[-1] // NUMERATOR)))
    return np.array(edges, np.int64)


BAND_EDGES = _band_edges()


def band_of(n: np.ndarray) -> np.ndarray:
    """Bands of sizes; linked sets are of one band or of neighbouring ones."""
    return np.searchsorted(BAND_EDGES, n, side="right").astype(np.int32)


def parts_by(bucket: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """An order by bucket, and each bucket's slice of it."""
    order = np.argsort(bucket, kind="stable")
    now = bucket[order]
    edge = np.flatnonzero(np.append(True, now[1:] != now[:-1]))[: len(now)]
    return order, [slice(i, j) for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(now)], strict=True)]


def heavy_shingles(docs: DataFrame, size: int = SHINGLE, least: int = HEAVY, most: int = HEAVY_LIST) -> tuple[np.ndarray, np.ndarray]:
    """48-bit shingles of more than `least` documents, in order, and their ranks by count. All documents are counted.

    Tasks send each distinct shingle once with its count, packed by bucket: sorted differences in byte planes, compressed.
    """
    import zstandard

    buckets = bucket_count(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            order, parts = parts_by((mix(tokens) % np.uint64(buckets)).astype(np.int64))
            tokens, counts = tokens[order], counts[order].astype("<u4")
            pack = zstandard.ZstdCompressor(level=1)
            plane = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
            blobs = [pack.compress(plane(np.diff(tokens[p], prepend=np.uint64(0)).astype("<u8")) + plane(counts[p])) for p in parts]
            first = [p.start for p in parts]
            return pa.record_batch([pa.array((mix(tokens[first]) % np.uint64(buckets)).astype(np.int64)), pa.array([p.stop - p.start for p in parts]), pa.array(blobs, pa.binary())], ["bucket", "entries", "blob"])

        for batch in batches:
            grams, _ = shingle_sets(words_of(batch.column(0), lower=True), size)
            held.append(grams[grams < COUNTED] & TOKEN)
            total += len(held[-1])
            if total > 2_000_000:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    def gather(group: pa.Table) -> pa.Table:
        unpack, tokens, counts = zstandard.ZstdDecompressor(), [], []
        for n, blob in zip(group.column("entries").to_pylist(), group.column("blob").to_pylist(), strict=True):
            raw = np.frombuffer(unpack.decompress(blob), np.uint8)
            tokens.append(np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64))
            counts.append(np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel())
        token, count = np.concatenate(tokens), np.concatenate(counts).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order]
        edge = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.add.reduceat(count, edge)
        return pa.table({"token": token[edge][count > least].view(np.int64), "n": count[count > least]})

    sent = docs.select("text").mapInArrow(send, "bucket long, entries long, blob binary")
    found = cut(sent.groupBy("bucket").applyInArrow(gather, "token long, n long"))
    while found.where(F.col("n") > least).count() > most:
        least *= 2
    rows = found.where(F.col("n") > least).toPandas()
    token, n = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(token)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    return token[order], rank[order]


def parity_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity of a set of so many shingles: a power of two, so that a wider one folds to a narrower one."""
    wide = 1 << np.ceil(np.log2(np.maximum(2 * n, LEAST_BITS))).astype(np.int64)
    return np.minimum(wide, MOST_BITS)


def parities(grams: np.ndarray, rows: np.ndarray, number: int) -> list[bytes]:
    """Each row's parity of the number of shingles at each of its places."""
    out, bits, place = [b""] * number, parity_bits(np.bincount(rows, minlength=number)), mix(grams + _STEP)
    for width in np.unique(bits).tolist():
        own = np.flatnonzero(bits == width)
        for low in range(0, len(own), max(1, AT_ONCE // width)):
            part = own[low : low + max(1, AT_ONCE // width)]
            i, j = np.searchsorted(rows, part), np.searchsorted(rows, part, side="right")
            at = np.arange(int((j - i).sum())) + np.repeat(i - (np.cumsum(j - i) - (j - i)), j - i)
            where = (place[at] % np.uint64(width)).astype(np.int64) + np.repeat(np.arange(len(part)) * width, j - i)
            odd = (np.bincount(where, minlength=len(part) * width) & 1).astype(bool).reshape(len(part), width)
            for k, row in zip(part.tolist(), np.packbits(odd, axis=1, bitorder="little"), strict=True):
                out[k] = row.tobytes()
    return out


def folded(blobs: list[bytes]) -> np.ndarray:
    """Parities as rows of 64-bit words, all as narrow as the narrowest: halves of a wider one are added up."""
    width = min(map(len, blobs)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in blobs])


def digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each row's set, in two halves; 0 for empty ones."""
    some, halves = np.diff(first) > 0, []
    for salt in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15)):
        half = np.zeros(len(some), np.uint64)
        if len(grams):
            half[some] = np.add.reduceat(mix(grams ^ salt), first[:-1][some])
        halves.append(half.view(np.int64))
    return halves[0], halves[1]


def sketches(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], size: int = SHINGLE) -> DataFrame:
    """doc_id, h, n, s1, s2 (a digest of the set), light (rare shingles of the prefix), prefix (48-bit shingles, rarest first), parity."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            grams, first = shingle_sets(words_of(batch.column(2), lower=True), size)
            n = np.diff(first)
            s1, s2 = digests(grams, first)
            key, token = grams >> np.uint64(2), grams & TOKEN
            if len(known) and len(grams):
                low = np.flatnonzero(grams < COUNTED)
                at = np.minimum(np.searchsorted(known, token[low]), len(known) - 1)
                hot = known[at] == token[low]
                key[low[hot]] = np.uint64(1 << 62) + rank[at[hot]].astype(np.uint64)
            key[grams >= COUNTED] |= np.uint64(1 << 63)
            rows = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((key, rows))
            by, keep = token[order], prefix_length(n) * (n > 0)
            rare = np.concatenate(([0], np.cumsum(key[order] < np.uint64(1 << 62))))
            light = np.minimum(rare[first[1:]] - rare[first[:-1]], keep)
            packed = by.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            blobs = [packed[i : i + k].tobytes() for i, k in zip(first[:-1].tolist(), keep.tolist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(s1), pa.array(s2), pa.array(light), pa.array(blobs, pa.binary()), pa.array(parities(grams, rows, len(n)), pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "h", "n", "s1", "s2", "light", "prefix", "parity"])

    return docs.select("doc_id", row_key("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, s1 long, s2 long, light long, prefix binary, parity binary")


def unpacked(blobs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


ENTRY = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<i8"), ("m", "<i4"), ("pos", "<i4")])


def entries_of(batch: pa.RecordBatch, light: bool) -> np.ndarray:
    """ENTRY rows of the rare, or of the other, prefix shingles of a batch of gid, n, m, light, prefix."""
    blobs = batch.column(4).to_pylist()
    each = np.array([len(x) // 6 for x in blobs], np.int64)
    rows = np.empty(int(each.sum()), ENTRY)
    rows["token"] = unpacked(blobs)
    for name, i in (("gid", 0), ("n", 1), ("m", 2)):
        rows[name] = np.repeat(batch.column(i).to_numpy(), each)
    rows["pos"] = np.arange(len(rows)) - np.repeat(np.cumsum(each) - each, each)
    rare = rows["pos"] < np.repeat(batch.column(3).to_numpy(), each)
    return rows[rare == light]


def in_bands(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, band): each entry in its own band, and in the next where larger sets may link by it."""
    band = band_of(rows["n"])
    low = rows["pos"] < lower_prefix_length(rows["n"])
    return np.concatenate([rows, rows[low]]), np.concatenate([band, band[low] + 1])


def rare_bundles(leaders: DataFrame, buckets: int) -> DataFrame:
    """pivot, band, gid of the rare prefix shingles, gathered in packed buckets; rows may repeat."""
    import zstandard

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            rows = np.concatenate(held)
            bucket = (mix(rows["token"]) % np.uint64(buckets)).astype(np.int64)
            order, parts = parts_by(bucket)
            rows, bucket = rows[order], bucket[order]
            pack, blobs = zstandard.ZstdCompressor(level=1), []
            for p in parts:
                part = rows[p].copy()
                part["gid"] = np.diff(part["gid"], prepend=0)
                blobs.append(pack.compress(b"".join(np.ascontiguousarray(part[c]).view(np.uint8).reshape(len(part), -1).T.tobytes() for c in ENTRY.names)))
            return pa.record_batch([pa.array(bucket[[p.start for p in parts]]), pa.array([p.stop - p.start for p in parts]), pa.array(blobs, pa.binary())], ["bucket", "entries", "blob"])

        for batch in batches:
            held.append(entries_of(batch, True))
            if sum(map(len, held)) > 1_000_000:
                yield flush()
                held.clear()
        if sum(map(len, held)):
            yield flush()

    def gather(group: pa.Table) -> pa.Table:
        unpack, parts = zstandard.ZstdDecompressor(), []
        for size, blob in zip(group.column("entries").to_pylist(), group.column("blob").to_pylist(), strict=True):
            raw, rows, at = np.frombuffer(unpack.decompress(blob), np.uint8), np.empty(size, ENTRY), 0
            for name in ENTRY.names:
                width = ENTRY[name].itemsize
                rows[name] = np.ascontiguousarray(raw[at : at + width * size].reshape(width, size).T).view(ENTRY[name]).ravel()
                at += width * size
            rows["gid"] = np.cumsum(rows["gid"])
            parts.append(rows)
        rows = np.concatenate(parts)
        order = np.argsort(rows["token"], kind="stable")
        token = rows["token"][order]
        twice = np.append(False, token[1:] == token[:-1])
        some = twice | np.append(twice[1:], False) | (rows["m"][order] > 1)
        rows, band = in_bands(rows[order[some]])
        if not len(rows):
            return pa.table({"pivot": pa.array([], pa.int64()), "band": pa.array([], pa.int32()), "gid": pa.array([], pa.int64())})
        order = np.lexsort((rows["gid"], band, rows["token"]))
        rows, band = rows[order], band[order]
        edge = np.flatnonzero(np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (band[1:] != band[:-1])))
        each = np.diff(np.append(edge, len(rows)))
        good = (np.add.reduceat(rows["m"].astype(np.int64), edge) > 1) & np.logical_or.reduceat(band_of(rows["n"]) == band, edge)
        keep = np.repeat(good, each)
        found = np.stack([np.repeat(rows["gid"][edge], each)[keep], band[keep], rows["gid"][keep]])
        found = np.unique(found, axis=1) if found.shape[1] else found
        return pa.table({"pivot": found[0], "band": found[1].astype(np.int32), "gid": found[2]})

    sent = leaders.mapInArrow(send, "bucket long, entries long, blob binary")
    return sent.groupBy("bucket").applyInArrow(gather, "pivot long, band int, gid long")


def frequent_bundles(leaders: DataFrame) -> DataFrame:
    """pivot, band, gid of the other prefix shingles: the pivot is a grouped minimum; rows may repeat."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, band = in_bands(entries_of(batch, False))
            own = band_of(rows["n"]) == band
            yield pa.record_batch([pa.array(rows["token"].view(np.int64)), pa.array(band), pa.array(np.ascontiguousarray(rows["gid"])), pa.array(np.ascontiguousarray(rows["m"])), pa.array(own)], ["token", "band", "gid", "m", "own"])

    some = leaders.where("length(prefix) > 6 * light")
    entries = cut(some.mapInArrow(send, "token long, band int, gid long, m int, own boolean"))
    pivots = entries.groupBy("token", "band").agg(F.min("gid").alias("pivot"), F.sum("m").alias("classes"), F.bool_or("own").alias("own"))
    pivots = cut(pivots.where("classes > 1 and own").select("token", "band", "pivot"))
    return entries.select("token", "band", "gid").join(maybe_broadcast(pivots), ["token", "band"]).select("pivot", "band", "gid")


KEYS = ("pivot", "band", "i", "j")


def placed(rows: DataFrame) -> DataFrame:
    """rows (pivot, band, uid, n, ...) with i, j, h: the pair of blocks of the bundle that a copy is for, and its own block."""
    sizes = rows.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("t") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    large = maybe_broadcast(cut(sizes.select("pivot", "band", blocks).where("blocks > 1")))
    rows = rows.join(large, ["pivot", "band"], "left").withColumn("h", F.coalesce(F.expr("cast(pmod(xxhash64(uid), blocks) as int)"), F.lit(0)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return rows.withColumns({"i": F.least("h", "other").cast("int"), "j": F.greatest("h", "other").cast("int")}).drop("blocks", "other")


def dealt(rows: DataFrame) -> DataFrame:
    """Placed rows, those of a pair of blocks one after the other in one task."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "uid")


def runs(batches: Iterator[pa.RecordBatch], key: int = 4) -> Iterator[pa.RecordBatch]:
    """Rows of equal first columns, one run at a time, from batches in order of these."""
    held: list[pa.RecordBatch] = []

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(key)])
        if held and any(held[0].column(c)[0].as_py() != keys[c, 0] for c in range(key)):
            yield whole()
            held = []
        edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        at = 0
        for edge in edges.tolist():
            held.append(batch.slice(at, edge - at))
            yield whole()
            held, at = [], edge
        held.append(batch.slice(at))
    if held:
        yield whole()


def common_bits(values: np.ndarray, rows: np.ndarray, number: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each pair (p, q) of rows the number of values that both have. values, rows: distinct pairs of a value and a row."""
    out = np.zeros(len(p), np.int64)
    if not len(values) or not len(p):
        return out
    order = np.argsort(values, kind="stable")
    value, row = values[order], rows[order]
    new = np.append(True, value[1:] != value[:-1])
    edge = np.flatnonzero(new)
    several = np.diff(np.append(edge, len(value))) > 1
    keep = np.repeat(several, np.diff(np.append(edge, len(value))))
    column, row = (np.cumsum(several) - 1)[np.cumsum(new) - 1][keep], row[keep]
    columns = int(several.sum())
    step = max(64, AT_ONCE // max(1, number)) // 64 * 64
    for low in range(0, columns, step):
        inside = (column >= low) & (column < low + step)
        bits = np.zeros((number, -(-min(step, columns - low) // 64) * 64), bool)
        bits[row[inside], column[inside] - low] = True
        words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        chunk = max(1, AT_ONCE // words.shape[1])
        for at in range(0, len(p), chunk):
            part = slice(at, at + chunk)
            out[part] += np.bitwise_count(words[p[part]] & words[q[part]]).sum(axis=1, dtype=np.int64)
    return out


class Block:
    """A run of dealt rows: pivot, band, i, j, uid, n, h, earlier (smaller pivots of the class in this band)."""

    def __init__(self, run: pa.RecordBatch):
        _, fresh = np.unique(run.column("uid").to_numpy(), return_index=True)  # copies of a class that rows of equal ids bring
        if len(fresh) < run.num_rows:
            run = run.take(pa.array(fresh))
        self.run, self.band = run, run.column("band")[0].as_py()
        self.uid, self.n, h = (run.column(c).to_numpy() for c in ("uid", "n", "h"))
        i, j = (run.column(c)[0].as_py() for c in ("i", "j"))
        self.left, self.right = (np.flatnonzero(h == i), np.flatnonzero(h == j))
        self.one = i == j

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The block's pairs (p, q) of rows whose sizes allow a link, some at a time."""
        if not len(self.left) or not len(self.right):
            return
        own = band_of(self.n) == self.band
        step = max(1, 250_000 // len(self.right))
        for at in range(0, len(self.left), step):
            p, q = self.left[at : at + step, None], self.right[None, :]
            good = (own[p] | own[q]) & (DENOMINATOR * np.minimum(self.n[p], self.n[q]) >= NUMERATOR * np.maximum(self.n[p], self.n[q]))
            if self.one:
                good &= p < q
            a, b = np.nonzero(good)
            if len(a):
                yield self.left[at : at + step][a], self.right[b]

    def parity(self) -> np.ndarray:
        if "parity" in self.run.schema.names:
            blobs = self.run.column("parity").to_pylist()
        else:
            sets = self.run.column("grams").to_pylist()
            blobs = parities(np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(len(sets)), [len(x) // 8 for x in sets]), len(sets))
        return folded(blobs)

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that parities allow to link and that no earlier bundle has."""
        parity, found = self.parity(), [(np.zeros(0, np.int64),) * 2]
        for p, q in self.pairs():
            total = self.n[p] + self.n[q]
            most = total - 2 * ((NUMERATOR * total + NUMERATOR + DENOMINATOR - 1) // (NUMERATOR + DENOMINATOR))
            chunk = max(1, AT_ONCE // parity.shape[1])
            apart = [np.bitwise_count(parity[p[k : k + chunk]] ^ parity[q[k : k + chunk]]).sum(axis=1, dtype=np.int64) for k in range(0, len(p), chunk)]
            good = np.concatenate(apart) <= most
            found.append((p[good], q[good]))
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        earlier = self.run.column("earlier")
        sizes, values = np.diff(earlier.offsets.to_numpy()), earlier.flatten().to_numpy()
        if len(values) and len(p):
            first = common_bits(values, np.repeat(np.arange(len(sizes)), sizes), len(sizes), p, q) == 0
            p, q = p[first], q[first]
        return p, q

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, of those near, whose whole sets link."""
        p, q = self.near()
        blobs = self.run.column("grams").to_pylist()
        sizes = np.array([len(x) // 8 for x in blobs], np.int64)
        common = common_bits(np.frombuffer(b"".join(blobs), np.uint64), np.repeat(np.arange(len(sizes)), sizes), len(sizes), p, q)
        good = DENOMINATOR * common >= NUMERATOR * (self.n[p] + self.n[q] - common)
        return p[good], q[good]


def least_linked(number: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of so many rows the first that links reach from it."""
    label = np.arange(number)
    while True:
        low = label.copy()
        np.minimum.at(low, p, label[q])
        np.minimum.at(low, q, label[p])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def near_classes(rows: DataFrame) -> DataFrame:
    """pivot, band, uid: the classes that are in a near pair of the bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for one in runs(batches):
            block = Block(one)
            some = np.unique(np.concatenate(block.near()))
            if len(some):
                held.append(block.run.select(["pivot", "band", "uid"]).take(pa.array(some)))
                total += len(some)
            if total > 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, total = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    own = rows.select("pivot", "band", "i", "j", "uid", "n", "h", "earlier", "parity")
    return own.mapInArrow(run, "pivot long, band int, uid long").distinct()


def block_links(rows: DataFrame, pairs: bool) -> DataFrame:
    """uid, hub, others: for each class of a block's links the first class that these reach, and the documents that it links with;
    or, if pairs are asked for, a, b: the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs(batches):
            block = Block(one)
            p, q = block.links()
            if not len(p):
                continue
            if pairs:
                for at in range(0, len(p), 100_000):
                    a, b = block.uid[p[at : at + 100_000]], block.uid[q[at : at + 100_000]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                continue
            members, others = block.run.column("members").to_numpy(), np.zeros(len(block.uid), np.int64)
            np.add.at(others, p, members[q])
            np.add.at(others, q, members[p])
            some = np.flatnonzero(others)
            yield pa.record_batch([pa.array(block.uid[some]), pa.array(block.uid[least_linked(len(block.uid), p, q)[some]]), pa.array(others[some])], ["uid", "hub", "others"])

    own = rows.select("pivot", "band", "i", "j", "uid", "n", "h", "earlier", "members", "grams")
    return own.mapInArrow(run, "a long, b long" if pairs else "uid long, hub long, others long")


def with_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (of: id and hash of a text; s1, s2, n, uid, members, places) with grams, the whole sets, instead of `of`, s1 and s2.

    Rows repeat where rows of docs agree in id and text. The hash spreads null and repeated ids over tasks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, first = shingle_sets(words_of(batch.column(0), lower=True), size)
            n = np.diff(first)
            same = n == batch.column("n").to_numpy()
            for half, name in zip(digests(grams, first), ("s1", "s2"), strict=True):
                same &= half == batch.column(name).to_numpy()
            blobs = [grams[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            out = batch.select(["n", "uid", "members", "places"]).append_column("grams", pa.array(blobs, pa.binary()))
            yield out.filter(pa.array(same))

    kinds = {f.name: f.dataType for f in wanted.schema}
    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in ("n", "uid", "members", "places")) + ", grams binary"
    keyed = docs.select("doc_id", "text", row_key("text").alias("own_h"))
    wanted = wanted.withColumns({"of_id": F.col("of.doc_id"), "of_h": F.col("of.h")}).drop("of")
    texts = keyed.join(maybe_broadcast(wanted, BROADCAST_WIDE), keyed["doc_id"].eqNullSafe(wanted["of_id"]) & (keyed["own_h"] == wanted["of_h"]))
    return texts.select("text", "s1", "s2", "n", "uid", "members", "places").mapInArrow(build, schema)


class Join:
    """The classes of docs and, block by block, their links."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, size: int, heavy: int = HEAVY):
        prepare(docs.sparkSession)
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        self.drawn = cut(sketches(docs, heavy_shingles(docs, size, heavy), size).withColumn("row", F.monotonically_increasing_id()))
        some = self.drawn.where("n > 0")
        self.classes = cut(some.groupBy("s1", "s2", "n").agg(F.min("row").alias("uid"), F.min_by(F.struct("doc_id", "h"), "row").alias("of"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")))
        self.rows = self._blocks(docs, some, size)

    def _blocks(self, docs: DataFrame, some: DataFrame, size: int) -> DataFrame:
        """The classes that may link, with their whole sets, dealt out in blocks."""
        copies = some.join(self.classes.where("members > 1"), ["s1", "s2", "n"]).where("row <> uid").select(F.col("row").alias("copy"))
        copies = maybe_broadcast(cut(copies))
        light = some.withColumnRenamed("row", "uid").join(copies, F.col("uid") == F.col("copy"), "left_anti")
        keys = ["n", "g1", "g2"]
        named = light.withColumns({"g1": F.xxhash64("prefix"), "g2": F.hash("prefix")}).select("uid", *keys)
        groups = maybe_broadcast(cut(named.groupBy(*keys).agg(F.min("uid").alias("gid"), F.count(F.lit(1)).cast("int").alias("m")).where("m > 1")))
        members = cut(named.join(groups, keys).select("gid", F.col("uid").alias("member"), "m"))
        followers = maybe_broadcast(cut(members.where("member <> gid").select("member")))
        sizes = maybe_broadcast(cut(members.where("member = gid").select("gid", "m")))
        leaders = light.join(followers, F.col("uid") == F.col("member"), "left_anti").withColumnRenamed("uid", "gid").join(sizes, "gid", "left")
        leaders = leaders.select("gid", "n", F.coalesce("m", F.lit(1)).alias("m"), "light", "prefix")

        entries = light.agg(F.sum("light")).first()[0] or 0
        buckets = max(bucket_count(docs.sparkSession), -(-entries // BUCKET_ENTRIES))
        bundles = rare_bundles(leaders, buckets).unionByName(frequent_bundles(leaders))
        of = cut(bundles.groupBy("gid", "band").agg(F.array_sort(F.collect_set("pivot")).alias("pivots")))
        of = of.join(maybe_broadcast(members.select("gid", "member")), "gid", "left").withColumn("uid", F.coalesce("member", "gid"))
        of = of.select("uid", "band", F.posexplode("pivots").alias("at", "pivot"), "pivots").select("uid", "band", "pivot", F.slice("pivots", F.lit(1), F.col("at")).alias("earlier"))
        of = cut(of.join(some.select(F.col("row").alias("uid"), "n", "parity"), "uid"))
        near = cut(near_classes(dealt(placed(of))))
        kept = placed(cut(near.join(of.drop("parity"), ["pivot", "band", "uid"])))
        places = kept.groupBy("uid").agg(F.collect_list(F.struct(*KEYS, "h", "earlier")).alias("places"))
        wanted = cut(places.join(self.classes, "uid"))
        sets = with_sets(docs, wanted, size).withColumn("place", F.explode("places"))
        return dealt(sets.select("uid", "n", "members", "grams", *(f"place.{c}" for c in (*KEYS, "h", "earlier"))))

    def documents(self) -> DataFrame:
        found = cut(block_links(self.rows, False))
        edges = components(found.where("uid <> hub").select("uid", "hub").distinct(), "uid", "hub")
        linked = found.groupBy("uid").agg(F.sum("others").alias("others")).join(edges.withColumnRenamed("id", "uid"), "uid")
        linked = cut(linked.join(self.classes.select("uid", "first_id"), "uid"))
        least = linked.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "uid")).alias("keeper"))
        linked = linked.join(least, "component").select("uid", F.col("keeper.first_id").alias("component_id"), (F.col("keeper.uid") == F.col("uid")).alias("first"), "others")
        classes = self.classes.join(maybe_broadcast(cut(linked)), "uid", "left")
        of = self.drawn.select("doc_id", "h", "n", "s1", "s2").join(classes.drop("uid"), ["s1", "s2", "n"], "left")
        stays = (F.coalesce("first", F.lit(True)) & F.col("doc_id").eqNullSafe(F.col("first_id"))) | (F.col("n") == 0)
        links = F.coalesce(F.col("members") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).alias("n_links")
        return of.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "first_id", "doc_id").alias("component_id"), F.coalesce("first_id", "doc_id").alias("class_id"), links, stays.alias("stays"))

    def pairs(self) -> DataFrame:
        first = self.classes.select("uid", "first_id")
        out = block_links(self.rows, True)
        for end in ("a", "b"):
            out = out.join(first.select(F.col("uid").alias(end), F.col("first_id").alias(f"id_{end}")), end)
        return out.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links: one row per row of docs.

    component_id: the smallest doc_id that links reach. class_id: the smallest doc_id among rows of the same set. n_links: the
    other rows with which the row links, those of its class among them. Null and empty texts have no shingles and no links and
    stand alone, under their own id. Rows are told apart by where they stand, not by id: repeated rows are one class, rows of
    one id with different texts are compared as any others, and rows of null id link like others and get the ids of those
    that they link with (null where these have none). Whole texts are read, however long: a block holds few long sets.
    Extra columns are not read; an empty table gives an empty result.
    """
    return Join(docs, text, doc_id, size, heavy).documents().drop("h", "stays")


def similar_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """a, b: all pairs of classes that link, by class_id as of similar_documents(), the smaller one first; a class of null ids alone
    is null. As many rows as there are links between different sets, which in a group of near copies is its size squared."""
    return Join(docs, text, doc_id, size, heavy).pairs()


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows that are not the first of their component.

    The first is the row of the smallest id; null ids come last. Of rows that agree in id and text all stay or go. Rows without
    shingles (null, empty, blank texts) stay.
    """
    return without_rows(docs, Join(docs, "text", "doc_id", SHINGLE).documents().where("not stays").select("doc_id", "h"))
