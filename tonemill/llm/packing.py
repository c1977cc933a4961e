"""Packing documents' token ids into windows, by non-negative least squares over a histogram of lengths.

Documents are cut on a grid that depends on their own length alone: whole windows, then a head of whole units (window /
64), then a tail shorter than a unit. So one pass over the texts gives every piece and its checksum, and only lengths are
left to arrange. Two levels share one solver. Tails are combined into blocks of exactly one unit; heads and blocks are
combined into windows of exactly 64 units. At each level all combinations of at most three different lengths (each any
number of times, the third at most eight) that fill the space are columns of A, and min ||A x - h||, x >= 0, against the histogram h gives how
often to repeat each; x is rounded down, and what is left over is packed greedily, largest lengths first.

The driver sees the histogram (at most 127 lengths) alone. A piece finds its place by its rank among pieces of its
length: a count a bucket, summed up over buckets, plus its rank in the bucket; so no length's pieces meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.common import bucket_count, cut, maybe_broadcast, prepare
from tonemill.llm.tokens import encoder, word_bpe_path

WINDOW, UNITS, END_ID = 4096, 64, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, window: int = WINDOW, units: int = UNITS) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    full, rest = divmod(n, window)
    head = rest - rest % (window // units)
    return [window] * full + [x for x in (head, rest - head) if x]


def pieces_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, window: int = WINDOW, units: int = UNITS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian unsigned 32-bit): a row per piece; null text is empty."""
    prepare(docs.sparkSession)
    path = path or word_bpe_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for d, coded in zip(part.column(0).to_pylist(), own.ids(part.column(1).to_pylist()), strict=True):
                    coded += end
                    at, view = 0, memoryview(coded)
                    for n in cuts(len(coded) // 4, window, units):
                        piece = view[4 * at : 4 * (at + n)]
                        doc.append(d)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        total.append(len(coded) // 4)
                        if with_ids:
                            ids.append(bytes(piece))
                        at += n
                columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)] + ([pa.array(ids, pa.binary())] if with_ids else [])
                yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def combinations(lengths: list[int], space: int) -> list[dict[int, int]]:
    """All multisets of at most three different lengths, the third at most eight times, that fill the space exactly."""
    out, have = [], set(lengths)
    order = sorted(have, reverse=True)
    for i, a in enumerate(order):
        for ka in range(1, space // a + 1):
            rest = space - ka * a
            if not rest:
                out.append({a: ka})
                continue
            for j in range(i + 1, len(order)):
                b = order[j]
                for kb in range(1, rest // b + 1):
                    left = rest - kb * b
                    if not left:
                        out.append({a: ka, b: kb})
                    else:  # the third length fills what is left, as often as it must
                        out += [{a: ka, b: kb, left // k: k} for k in range(1, min(left, 8) + 1) if left % k == 0 and left // k < b and left // k in have]
    return out


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises ||matrix x - target||: an active set of columns, grown by the steepest one."""
    x = np.zeros(matrix.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ x)
        slope[active] = -np.inf
        new = int(np.argmax(slope)) if len(slope) else -1
        if new < 0 or slope[new] <= tolerance:
            break
        active.append(new)
        while active:
            best = np.linalg.lstsq(matrix[:, active], target, rcond=None)[0]
            if (best > 0).all():
                x[:] = 0
                x[active] = best
                break
            now = x[active]
            down = best <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - best[down], 1e-300)))
            moved = now + step * (best - now)
            keep = moved > 1e-12 * max(1.0, float(moved.max(initial=0)))
            keep[np.flatnonzero(down)[np.argmin(now[down] / np.maximum(now[down] - best[down], 1e-300))]] = False
            x[:] = 0
            x[np.array(active)[keep]] = moved[keep]
            active = [c for c, k in zip(active, keep, strict=True) if k]
    return x


def repeats(counts: dict[int, int], space: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times): whole repeats that together use no more than the counts."""
    lengths = sorted(k for k, n in counts.items() if n > 0)
    columns = combinations(lengths, space)
    if not columns:
        return []
    row = {length: i for i, length in enumerate(lengths)}
    matrix = np.zeros((len(lengths), len(columns)))
    for j, column in enumerate(columns):
        for length, k in column.items():
            matrix[row[length], j] = k
    target = np.array([counts[k] for k in lengths], dtype=float)
    x = nnls(matrix, target / target.max()) * target.max()
    left, out = dict(counts), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        times = min([int(x[j] + 1e-6), *(left[length] // k for length, k in columns[j].items())])
        if times > 0:
            out.append((columns[j], times))
            for length, k in columns[j].items():
                left[length] -= k * times
    return out


def greedy(counts: dict[int, int], space: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times) that use all counts: fill with the largest lengths that fit, repeat while the counts last."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        room, taken = space, {}
        for length in sorted(left, reverse=True):
            if k := min(left[length], room // length):
                taken[length], room = k, room - k * length
        times = min(left[length] // k for length, k in taken.items())
        out.append((taken, times))
        left = {length: n for length, n in ((length, n - times * taken.get(length, 0)) for length, n in left.items()) if n}
    return out


@dataclass
class Runs:
    """Where the pieces of one length go, by rank: from rank at[i] on, k[i] to a space, spaces from base[i], at offset[i]."""

    at: list[int] = field(default_factory=lambda: [0])
    k: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    in_block: list[bool] = field(default_factory=list)

    def add(self, k: int, times: int, base: int, offset: int, in_block: bool) -> None:
        self.at.append(self.at[-1] + k * times)
        self.k.append(k)
        self.base.append(base)
        self.offset.append(offset)
        self.in_block.append(in_block)

    def place(self, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.searchsorted(np.array(self.at), rank, side="right") - 1
        k = np.array(self.k)[i]
        space, copy = np.divmod(rank - np.array(self.at)[i], k)
        return np.array(self.base)[i] + space, np.array(self.offset)[i] + copy * length, np.array(self.in_block)[i]


class Layout:
    """A place for every piece, by its length and rank."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW, units: int = UNITS):
        self.window, self.unit = window, window // units
        unit, left = self.unit, {k: n for k, n in counts.items() if n and k != window}
        self.runs: dict[int, Runs] = {k: Runs() for k in [*left, unit, window]}
        blocks = 0
        for combination, times in repeats({k: n for k, n in left.items() if k < unit}, unit):
            self._add(combination, times, blocks, True, left)
            blocks += times
        self.own_units = left.get(unit, 0)  # pieces of one unit; blocks rank after them
        if blocks:
            left[unit] = self.own_units + blocks
        sequences = 0
        for combination, times in repeats({k // unit: n for k, n in left.items() if k >= unit}, units):
            self._add({k * unit: n for k, n in combination.items()}, times, sequences, False, left)
            sequences += times
        for combination, times in greedy(left, window):
            self._add(combination, times, sequences, False, left)
            sequences += times
        if counts.get(window):
            self.runs[window].add(1, counts[window], sequences, 0, False)
        self.sequences = sequences + counts.get(window, 0)

    def _add(self, combination: dict[int, int], times: int, base: int, in_block: bool, left: dict[int, int]) -> None:
        offset = 0
        for length in sorted(combination, reverse=True):
            k = combination[length]
            self.runs[length].add(k, times, base, offset, in_block)
            offset += k * length
            left[length] -= k * times

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for value in np.unique(length):
            rows = np.flatnonzero(length == value)
            space, at, in_block = self.runs[int(value)].place(rank[rows], int(value))
            if in_block.any():
                outer, start, _ = self.runs[self.unit].place(space[in_block] + self.own_units, self.unit)
                space[in_block], at[in_block] = outer, start + at[in_block]
            sequence[rows], offset[rows] = space, at
        return sequence, offset


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank: 0, 1, ... among those of equal length."""
    n = bucket_count(pieces.sparkSession)
    own = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)).cast("int"))
    counts = own.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    own = own.withColumn("at", F.row_number().over(order) - 1)
    return own.join(maybe_broadcast(starts), ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("at")).drop("bucket", "first", "at")


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, window: int = WINDOW, units: int = UNITS, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece of every document and its place.

    Null and empty texts are the end id alone; a very long text is cut into as many whole windows as it fills and a rest;
    repeated rows are packed each; null ids are kept as such; ties in rank are broken by id, start and checksum; an empty table
    gives an empty result; extra columns are not read. Only the last sequences, of left-over lengths, are not full.
    """
    return placed(cut(pieces_of(docs, text, doc_id, path, window, units, end_id)), window, units)


def placed(pieces: DataFrame, window: int = WINDOW, units: int = UNITS) -> DataFrame:
    """pieces (a table that is cut) with sequence_id and offset."""
    layout = Layout({r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}, window, units)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield batch.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    names = pieces.columns
    schema = ", ".join(f"{c} {kind}" for c, kind in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked(pieces).mapInArrow(place, schema)


def sequences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, window: int = WINDOW, units: int = UNITS, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (binary, little-endian unsigned 32-bit), docs (spans): the packed windows themselves, by the rules of pack()."""
    rows = placed(cut(pieces_of(docs, text, doc_id, path, window, units, end_id, with_ids=True)), window, units)
    spans = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    out = rows.groupBy("sequence_id").agg(spans.alias("p"))
    return out.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"), F.expr("transform(p, x -> struct(x.offset, x.doc_id, x.start, x.length))").alias("docs"))
