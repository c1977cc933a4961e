"""Removal of word windows that an earlier document has, by super-k-mer partitioning.

The minimiser of a 13-word window is the least hash among its 3-word grams. Consecutive windows of one minimiser travel
as one packed string (a super-k-mer) to the minimiser's bucket. Equal windows have equal minimisers, so each bucket sees
all occurrences of its windows: it hashes and sorts them, compares the bytes of those with equal hashes, and finds the
smallest doc_id of each. Before sending, a task keeps each packed string once, with its smallest doc_id and the list of
where it stands.

Grams in a noticeable share of documents rank after all others, so that no common line or phrase rules a bucket. Windows
made up of such grams alone (the inside of a passage or text with very many copies) travel by a minimiser of longer grams,
and without the list of their places, which may be most of the corpus: a bucket gets each task's distinct strings,
compares bytes like any other, and sends each task's smallest ids back to where the places were left.

Texts that lose words meet their ranges in buckets by doc_id, packed and compressed as well; all others stay where they are. A
row is known by its doc_id and a 32-bit hash of its text (mark), so that rows which repeat an id with other texts are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import BROADCAST_ROWS, WHITE, Words, bucket_count, cut, gram_hashes, gram_starts, hash_words, mix, prepare, text_arrays
from tonemill.llm.ngram_jaccard import common_shingles

WINDOW, GRAM = 13, 3
#: Buckets to a shuffle partition, so that a bucket's windows are sorted in little memory; super-k-mers, and their bytes, that a task
#: holds; windows of a super-k-mer.
SPLIT, HELD, BYTES, LONGEST = 4, 250_000, 64 << 20, 4096
HOT = np.uint64(1 << 63)
#: Words fewer than a window's in the grams whose minimiser parts windows of common grams.
SHORTER = 4
#: A gram in so many documents is common, however small their share, so that no minimiser brings a bucket more of them.
MOST = 4_000_000
#: Ranges, and bytes of texts, that a task holds before it packs them by bucket.
RANGES_HELD, BYTES_HELD = 1_000_000, 32 << 20
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"
RANGES = "doc_id long, mark int, first long, last long"


def squeezed(body: np.ndarray, rows: np.ndarray) -> Words:
    """The words of a batch, over a buffer in which single spaces part them."""
    white = WHITE[body]
    keep = ~white
    keep[1:] |= ~white[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))
    body = np.where(white, np.uint8(32), body)[keep]
    return Words(body, at[rows])


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows inside rows: the first word, the row's number of windows, and a 64-bit hash."""
    at, count = gram_starts(words.first, size)
    return at, count, gram_hashes(hash_words(words), size)[at] if len(at) else np.zeros(0, np.uint64)


def in_set(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted known ones; a bit table rules most out before they are looked up."""
    bits = max(16, len(known).bit_length() + 4)
    table, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
    table[known >> shift] = True
    out = table[keys >> shift]
    maybe = np.flatnonzero(out)
    if len(maybe):
        out[maybe] = known[np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)] == keys[maybe]
    return out


class Pieces:
    """Super-k-mers of a task: distinct packed strings, the smallest id of each, and where each stands."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.least: list[int] = []
        self.at: list[int] = []
        self.doc: list[int] = []
        self.mark: list[int] = []
        self.start: list[int] = []

    def add(self, text: bytes, doc: int, mark: int, start: int) -> None:
        i = self.index.get(text)
        if i is None:
            i = self.index[text] = len(self.least)
            self.least.append(doc)
        elif doc < self.least[i]:
            self.least[i] = doc
        self.at.append(i)
        self.doc.append(doc)
        self.mark.append(mark)
        self.start.append(start)

    def packed(self) -> bytes:
        import zstandard

        head = np.array([len(self.least), len(self.at)], "<i8").tobytes()
        arrays = [np.array(x, t).tobytes() for x, t in ((self.least, "<i8"), (self.at, "<i4"), (self.doc, "<i8"), (self.mark, "<i4"), (self.start, "<i4"))]
        return zstandard.ZstdCompressor(level=6).compress(head + b"".join(arrays) + b"\n".join(self.index))


def unpacked(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings, a line each; smallest ids; and of each place the string's number, the document, its mark and the first word."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    kinds, places = np.frombuffer(raw, "<i8", 2)
    at, out = 16, []
    for n, t in ((kinds, "<i8"), (places, "<i4"), (places, "<i8"), (places, "<i4"), (places, "<i4")):
        out.append(np.frombuffer(raw, t, n, at))
        at += int(n) * np.dtype(t).itemsize
    return (raw[at:], *out)


def lines_of(text: bytes, lines: int) -> Words:
    """The words of packed strings that newlines part; a row is a string."""
    body = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(body == 10)
    return Words(body, np.concatenate(([0], ends, [len(body)]))[: lines + 1] if lines else np.zeros(1, np.int64))


def sliding_least(key: np.ndarray, more: int) -> np.ndarray:
    """The least of each entry and so many after it."""
    n, width = len(key) - more, 1
    while 2 * width <= more + 1:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    return np.minimum(key[:n], key[more + 1 - width :][:n])


def super_kmers(docs: DataFrame, frequent: np.ndarray, size: int, gram: int, hot: bool) -> DataFrame:
    """bucket, blob: packed super-k-mers by bucket, a blob for each of a task's shares; if hot, those of common grams alone."""
    buckets, frequent = SPLIT * bucket_count(docs.sparkSession), np.sort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Pieces] = {}
        total = bytes_held = 0
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            words = squeezed(*text_arrays(batch.column(1)))
            at, count = gram_starts(words.first, size)
            if not len(at):
                continue
            hashes = hash_words(words)
            key = gram_hashes(hashes, gram)
            key = (key >> np.uint64(1)) | (in_set(key, frequent).astype(np.uint64) << np.uint64(63))
            least = sliding_least(key, size - gram)[at]
            common = least >= HOT
            if hot:
                if not common.any():
                    continue
                long = max(gram, size - SHORTER)
                least = sliding_least(gram_hashes(hashes, long), size - long)[at]
            row = np.repeat(np.arange(len(count)), count)
            edge = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (common[1:] != common[:-1])))
            size_of = np.diff(np.append(edge, len(at)))
            if len(edge) and size_of.max() > LONGEST:  # one word through a long text, say
                parts = -(-size_of // LONGEST)
                edge = np.repeat(edge, parts) + LONGEST * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
            wanted = common[edge] == hot
            last = np.append(edge[1:], len(at)) - 1
            edge, last = edge[wanted], last[wanted]
            bucket = (mix(least[edge]) % np.uint64(buckets)).astype(np.int64)
            first_word = at[edge]
            text, low, high = words.body.tobytes(), words.start[first_word], words.end[at[last] + size - 1]
            inside = first_word - words.first[row[edge]]
            for b, i, j, d, m, s in zip(bucket.tolist(), low.tolist(), high.tolist(), ids[row[edge]].tolist(), marks[row[edge]].tolist(), inside.tolist(), strict=True):
                if (own := held.get(b)) is None:
                    own = held[b] = Pieces()
                own.add(text[i:j], d, m, s)
                total, bytes_held = total + 1, bytes_held + j - i
                if total > HELD or bytes_held > BYTES:
                    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([p.packed() for p in held.values()], pa.binary())], ["bucket", "blob"])
                    held, total, bytes_held = {}, 0, 0
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([p.packed() for p in held.values()], pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(run, "bucket long, blob binary")


def earliest(hashes: np.ndarray, doc: np.ndarray, text: bytes, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each window the smallest doc of those with the same bytes; hashes bring equals together, bytes decide."""
    order = np.argsort(hashes)
    first = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
    edge = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    out = np.empty(len(doc), np.int64)
    out[order] = np.minimum.reduceat(doc[order], edge)[group] if len(order) else doc
    pairs = np.flatnonzero(~first)
    head, other = order[edge[group[pairs]]], order[pairs]
    same = np.array([text[i:j] == text[k:m] for i, j, k, m in zip(low[other].tolist(), high[other].tolist(), low[head].tolist(), high[head].tolist(), strict=True)], bool)
    for g in np.unique(group[pairs[~same]]).tolist():
        own = order[group == g]  # a collision of hashes: group these by their bytes
        least: dict[bytes, int] = {}
        for w in own.tolist():
            t = text[low[w] : high[w]]
            least[t] = min(least.get(t, int(doc[w])), int(doc[w]))
        for w in own.tolist():
            out[w] = least[text[low[w] : high[w]]]
    return out


def to_remove(first_window: np.ndarray, windows: np.ndarray, least: np.ndarray, at: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, size: int) -> pa.RecordBatch:
    """Ranges of words of each document that lie in windows with a smaller least id.

    first_window, windows: where a string's windows begin, and how many they are. least: each window's smallest id. at, doc,
    mark, start: a place's string, document, the document's mark and the first word.
    """
    lowest = np.minimum.reduceat(least, first_window) if len(first_window) else np.zeros(0, np.int64)
    some = lowest[at] < doc
    at, doc, mark, start = at[some], doc[some], mark[some], start[some]
    count = windows[at]
    shift = np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else np.zeros(0, np.int64), count)
    inside = np.arange(int(count.sum())) - shift
    place = np.repeat(np.arange(len(at)), count)
    hit = least[first_window[at][place] + inside] < doc[place]
    place, inside = place[hit], inside[hit]
    new = np.append(True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1))[: len(place)]
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(place))[: len(edge)] - 1
    begin = start[place[edge]] + inside[edge]
    end = start[place[edge]] + inside[last] + size
    return pa.record_batch([pa.array(doc[place[edge]]), pa.array(mark[place[edge]]), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64))], ["doc_id", "mark", "first", "last"])


def repeated_ranges(docs: DataFrame, size: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, mark, first, last: ranges of words covered by windows that a document of a smaller id has; they may overlap."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.hash("text").alias("mark"))
    frequent = common_shingles(docs, gram, lower=False, most=MOST)

    cold = super_kmers(docs, frequent, size, gram, hot=False).groupBy("bucket").applyInArrow(_settler(size), RANGES)
    if not len(frequent):
        return cut(cold)
    passages = cut(super_kmers(docs, frequent, size, gram, hot=True).withColumn("share", F.monotonically_increasing_id()))
    answers = passages.mapInArrow(_without_places, "bucket long, share long, blob binary").groupBy("bucket").applyInArrow(_answerer(size), "to long, least binary")
    back = passages.join(answers, F.col("share") == F.col("to"), "left").select("blob", "least")
    return cut(cold.unionByName(back.mapInArrow(_marker(size), RANGES)))


def _least_ids(texts: list[bytes], owners: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which distinct string each packed string is, blob after blob; the distinct ones' numbers of windows, and each window's smallest id."""
    index: dict[bytes, int] = {}
    which = np.array([index.setdefault(t, len(index)) for text, owner in zip(texts, owners, strict=True) for t in text.split(b"\n")[: len(owner)]], np.int64)
    owner = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, np.concatenate(owners))
    text = b"\n".join(index)
    words = lines_of(text, len(index))
    begin, count, hashes = window_hashes(words, size)
    return which, count, earliest(hashes, np.repeat(owner, count), text, words.start[begin], words.end[begin + size - 1])


def _settler(size: int):
    """A bucket's ranges to remove."""

    def settle(group: pa.Table) -> pa.Table:
        parts = [unpacked(b) for b in group.column("blob").to_pylist()]
        which, count, least = _least_ids([p[0] for p in parts], [p[1] for p in parts], size)
        shift = np.repeat(np.cumsum([0, *(len(p[1]) for p in parts[:-1])]), [len(p[2]) for p in parts])
        at, doc, mark, start = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4, 5))
        return pa.Table.from_batches([to_remove(np.cumsum(count) - count, count, least, which[at + shift], doc, mark, start, size)])

    return settle


def _without_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same blobs, with strings and smallest ids alone."""
    import zstandard

    for batch in batches:
        for bucket, blob, share in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text, owner, *_ = unpacked(blob)
            lean = zstandard.ZstdCompressor(level=6).compress(np.array([len(owner), 0], "<i8").tobytes() + owner.tobytes() + text)
            yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([share], pa.int64()), pa.array([lean], pa.binary())], ["bucket", "share", "blob"])


def _answerer(size: int):
    """For each of a bucket's blobs the smallest ids of its windows; none for a blob whose own ids are the smallest."""

    def answer(group: pa.Table) -> pa.Table:
        import zstandard

        parts = [unpacked(b) for b in group.column("blob").to_pylist()]
        which, count, least = _least_ids([p[0] for p in parts], [p[1] for p in parts], size)
        begin, to, out, string = np.cumsum(count) - count, [], [], 0
        for share, part in zip(group.column("share").to_pylist(), parts, strict=True):
            own = which[string : string + len(part[1])]
            string, windows = string + len(own), count[own]
            inside = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            own = least[np.repeat(begin[own], windows) + inside]
            if (own < np.repeat(part[1], windows)).any():
                to.append(share)
                out.append(zstandard.ZstdCompressor(level=6).compress(own.astype("<i8").tobytes()))
        return pa.table([pa.array(to, pa.int64()), pa.array(out, pa.binary())], ["to", "least"])

    return answer


def _marker(size: int):
    """The ranges to remove of blobs and the smallest ids that were sent back to them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for blob, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, owner, at, doc, mark, start = unpacked(blob)
                _, count = gram_starts(lines_of(text, len(owner)).first, size)
                least = np.repeat(owner, count) if sent is None else np.frombuffer(zstandard.ZstdDecompressor().decompress(sent), "<i8")
                yield to_remove(np.cumsum(count) - count, count, least, at.astype(np.int64), doc, mark, start, size)

    return mark


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words, parted by one space): one row per row of docs.

    Words end at ASCII white space and are compared unchanged. Null and empty texts have no words; documents shorter than
    a window lose none. A null doc_id neither loses words nor counts as earlier. Of rows that repeat a doc_id, with the same text
    or others, none is earlier than the other. Whole texts count, however long: what a task holds is bounded in bytes, but for
    the text at hand. Equal words have no ties to break. Extra columns are not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = SPLIT * bucket_count(docs.sparkSession)
    ranges = repeated_ranges(docs, size)
    marked = docs.withColumn("mark", F.hash("text"))
    touched = cut(ranges.select("doc_id", "mark").distinct())
    few = touched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # beyond the bound all texts are sent, which is less than to send them twice for a join and a bucket
    sent = marked.join(F.broadcast(touched), ["doc_id", "mark"], "left_semi") if few else marked.where("doc_id is not null")
    left = marked.join(F.broadcast(touched), ["doc_id", "mark"], "left_anti") if few else marked.where("doc_id is null")
    spans = ranges.mapInArrow(_pack_ranges(buckets), "bucket long, blob binary").groupBy("bucket")
    texts = sent.select("doc_id", "text", "mark").mapInArrow(_pack_texts(buckets), "bucket long, blob binary").groupBy("bucket")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _kept_rows([(i, *_kept((t or "").encode(), [], [])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    return texts.cogroup(spans).applyInArrow(_remove, KEPT).unionByName(left.select("doc_id", "text").mapInArrow(whole, KEPT))


def _kept(text: bytes, first, last) -> tuple[int, int, bytes]:
    """The number of words, of those in the ranges, and the others joined by one space."""
    words = text.split()  # at the six bytes of white space, as words() ends them
    n = len(words)
    if len(first):
        drop = np.zeros(n + 1, np.int64)
        np.add.at(drop, np.minimum(first, n), 1)
        np.add.at(drop, np.minimum(last, n), -1)
        words = [w for w, d in zip(words, np.cumsum(drop)[:n].tolist(), strict=True) if d <= 0]
    return n, n - len(words), b" ".join(words)


def _kept_rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, total, gone, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parted(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the rows that go there."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for rows in np.split(order, edge[1:]) if len(order) else ():
        yield int(bucket[rows[0]]), rows


def _blobs(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    import zstandard

    press = zstandard.ZstdCompressor(level=6).compress
    return pa.record_batch([pa.array([b for b, _ in found], pa.int64()), pa.array([press(raw) for _, raw in found], pa.binary())], ["bucket", "blob"])


def _pack_ranges(buckets: int):
    """Ranges by their document's bucket, a blob for each of a task's shares."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush():
            rows = np.concatenate(held, axis=1)
            return _blobs([(b, np.ascontiguousarray(rows[:, at]).tobytes()) for b, at in _parted(_bucket_of(rows[0], buckets))])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype("<i8"))
            total += batch.num_rows
            if total > RANGES_HELD:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    return pack


def _pack_texts(buckets: int):
    """Documents by bucket, a blob for each of a task's shares: their number, ids, marks, lengths in bytes, and texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, texts, total = [], [], [], 0

        def flush():
            out = []
            for b, at in _parted(_bucket_of(np.array(ids, np.int64), buckets)):
                own = [texts[i] for i in at.tolist()]
                head = np.array([len(own), *(ids[i] for i in at.tolist()), *(marks[i] for i in at.tolist()), *map(len, own)], "<i8").tobytes()
                out.append((b, head + b"".join(own)))
            return _blobs(out)

        for batch in batches:
            for i, t, m in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids.append(i)
                marks.append(m)
                texts.append((t or "").encode())
                total += len(texts[-1]) + 64
                if total > BYTES_HELD:
                    yield flush()
                    ids, marks, texts, total = [], [], [], 0
        if ids:
            yield flush()

    return pack


def _remove(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """A bucket's documents without the words in their ranges."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    doc, mark, first, last = np.concatenate([np.zeros((4, 0), "<i8"), *(np.frombuffer(expand(b), "<i8").reshape(4, -1) for b in spans.column("blob").to_pylist())], axis=1)
    order = np.lexsort((mark, doc))
    doc, mark, first, last = doc[order], mark[order], first[order], last[order]
    edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))[: len(doc)]
    ranges = {(i, m): (j, k) for i, m, j, k in zip(doc[edge].tolist(), mark[edge].tolist(), edge.tolist(), np.append(edge[1:], len(doc)).tolist(), strict=False)}
    out = [_kept_rows([])]
    for blob in texts.column("blob").to_pylist():
        raw = expand(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, marks, sizes = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        ends = np.cumsum(sizes) + 8 + 24 * n
        begin = [8 + 24 * n, *ends[:-1].tolist()]
        rows = []
        for i, m, x, y in zip(ids.tolist(), marks.tolist(), begin, ends.tolist(), strict=True):
            j, k = ranges.get((i, m), (0, 0))
            rows.append((i, *_kept(raw[x:y], first[j:k], last[j:k])))
        out.append(_kept_rows(rows))
    return pa.Table.from_batches(out)
