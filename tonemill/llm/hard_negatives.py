"""Hard negatives by dual-tree search: trees over anchors and candidates, intervals of inner products between their nodes.

The trees have three levels. A split tree, fitted to a bounded sample, sends every row to a cell; anchors gather in blocks (a cell
or several, cut to a bounded number of rows), candidates in cells. For each block and cell the interval of inner products that
their balls allow is held against what the block's anchors still need, and only pairs that can matter go on. Candidates are
dealt to strips, so that a block meets its candidates in several tasks and a large cell is in many. In a task both sides are cut
further, to groups of anchors and leaves of candidates; again one interval rules out a whole group, and what remains is scored
exactly in small products. A task keeps the best few of each anchor; their best are taken in Spark.

Two searches: an anchor's positives (best rows of its label), and then, for each of these, the best rows of other labels whose
scores lie in a window below the positive's. First bounds come from the sample; they only spare work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import cut, maybe_broadcast, prepare

#: Rows of the sample that the splits are fitted to; anchors of a block; rows by which cells and strips are counted; strips of a block.
SAMPLE, BLOCK, CELL, STRIP, STRIPS, DEPTH = 4096, 8192, 2048, 4096, 256, 9
#: Candidates that a task holds at a time; rows of a leaf and of a group of anchors; found rows after which a task keeps the best.
HELD, LEAF, GROUP, FOUND = 4096, 128, 64, 50_000
LOW, HIGH = -(2**62), 2**62


def packed(q: np.ndarray) -> bytes:
    """Whole numbers as bytes: two each where they fit, else doubles; the first byte tells which."""
    small = not len(q) or np.abs(q).max() <= 32767
    return (b"2" + q.astype("<i2").tobytes()) if small else (b"8" + q.astype("<f8").tobytes())


def unpacked(column: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    rows = [np.frombuffer(b, "<i2" if b[:1] == b"2" else "<f8", offset=1) for b in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = max(a.shape[1], b.shape[1])
    return widened(a, d) @ widened(b, d).T


@dataclass
class Balls:
    centre: np.ndarray
    radius: np.ndarray

    @staticmethod
    def of(x: np.ndarray, parts: list[np.ndarray]) -> Balls:
        centre = np.array([x[p].mean(0) for p in parts]).reshape(len(parts), x.shape[1])
        return Balls(centre, np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centre, strict=True)]))

    def interval(self, other: Balls) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product between a point of each ball of one side and of the other."""
        middle = products(self.centre, other.centre)
        a, b = (np.sqrt((s.centre**2).sum(1)) for s in (self, other))
        slack = a[:, None] * other.radius + self.radius[:, None] * (b + other.radius)
        slack += 1e-9 * (np.abs(middle) + slack) + 1e-6
        return middle - slack, middle + slack


def halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows parted at the median of their widest coordinate, again and again, down to at most so many."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        order = part[np.argsort(x[part, int(np.argmax(x[part].var(0)))], kind="stable")] if x.shape[1] else part
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


@dataclass
class Splits:
    """A binary tree of hyperplanes in heap order; rows beyond a plane go right."""

    depth: int
    normal: np.ndarray
    at: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, depth: int) -> Splits:
        out = Splits(depth, np.zeros((2**depth, x.shape[1])), np.zeros(2**depth))
        node = np.ones(len(x), np.int64)
        for k in range(1, 2**depth):
            own = x[node == k]
            if len(own) > 1 and x.shape[1]:
                own = own - own.mean(0)
                v = own[int(np.argmax((own**2).sum(1)))]
                for _ in range(8):  # towards the direction of greatest spread
                    v = own.T @ (own @ v)
                    v = v / max(float(np.sqrt(v @ v)), 1e-300)
                out.normal[k], out.at[k] = v, np.median(x[node == k] @ v)
            node = np.where(node == k, 2 * node + (x @ out.normal[k] > out.at[k]), node)
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        x, normal = widened(x, self.normal.shape[1])[:, : self.normal.shape[1]], self.normal
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + ((x * normal[node]).sum(1) > self.at[node])
        return node - 2**self.depth


class Best:
    """The k greatest scores of each slot, ties by id; a slot's rows below `low` or above `cap` do not count."""

    def __init__(self, low: np.ndarray, cap: np.ndarray, k: int):
        self.k, self.cap, self.low = k, cap, low.astype(np.float64)
        self.low_id = np.full(len(low), np.iinfo(np.int64).max)
        self.found, self.new = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0

    def add(self, slots: np.ndarray, scores: np.ndarray, able: np.ndarray, ids: np.ndarray) -> None:
        """scores of these slots (rows) with candidates (columns), where able."""
        low, cap = self.low[slots, None], self.cap[slots, None]
        good = able & (scores <= cap) & ((scores > low) | ((scores == low) & (ids <= self.low_id[slots, None])))
        i, j = np.nonzero(good)
        if len(i):
            self.found.append((slots[i], scores[i, j], ids[j]))
            self.new += len(i)
            if self.new > FOUND:
                self.keep()

    def keep(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        few = place < self.k
        slot, score, ids, place = slot[few], score[few], ids[few], place[few]
        last = place == self.k - 1
        self.low[slot[last]], self.low_id[slot[last]] = score[last], ids[last]
        self.found, self.new = [(slot, score, ids)], 0
        return slot, score, ids


class Anchors:
    """The anchors of a block, as a tree of groups."""

    def __init__(self, rows: pa.Table, k: int, same: bool):
        self.x, self.row, self.label, self.same = unpacked(rows.column("vector")), rows.column("row").to_numpy(), rows.column("label").to_numpy(), same
        lows = rows.column("low").combine_chunks()
        self.sizes = np.diff(lows.offsets.to_numpy())
        self.owner = np.repeat(np.arange(len(self.row)), self.sizes)  # slot -> anchor
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.best = Best(lows.flatten().to_numpy(), rows.column("cap").combine_chunks().flatten().to_numpy().astype(np.float64), k)
        self.groups = halves(self.x, GROUP)
        self.balls = Balls.of(self.x, self.groups)
        self.slots = [np.flatnonzero(np.isin(self.owner, g)) for g in self.groups]

    def meet(self, x: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        leaves = halves(x, LEAF)
        least, most = self.balls.interval(Balls.of(x, leaves))
        for at in np.argsort(-most, axis=None, kind="stable"):
            g, c = divmod(int(at), len(leaves))
            slots = self.slots[g]
            if not len(slots) or most[g, c] < self.best.low[slots].min() or least[g, c] > self.best.cap[slots].max():
                continue  # no anchor of the group can need a row of the leaf
            leaf, who = leaves[c], self.owner[slots]
            scores = products(self.x[who], x[leaf])
            able = ((self.label[who, None] == label[leaf]) == self.same) & (self.row[who, None] != row[leaf])
            self.best.add(slots, scores, able, ids[leaf])

    def found(self) -> pa.RecordBatch:
        slot, score, ids = self.best.keep()
        some, first = np.unique(slot, return_index=True)
        ends = np.append(first, len(slot)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (np.clip(score, LOW, HIGH).astype(np.int64), ids)]
        return pa.record_batch([pa.array(self.row[self.owner[some]]), pa.array(self.place[some].astype(np.int32)), *lists], ["row", "slot", "scores", "ids"])


def search(rows: DataFrame, k: int, same: bool) -> DataFrame:
    """row, slot, best (score, id): the k best of each anchor's slots. rows: block, strip, side (0 anchors, 1 candidates), ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, side, held, count, anchors = None, None, [], 0, None

        def flush() -> None:
            nonlocal anchors, held, count
            if held:
                part = pa.Table.from_batches(held)
                if side == 0:
                    anchors = Anchors(part, k, same)
                elif anchors is not None:  # a strip may have no anchors for a block that lost all slots
                    anchors.meet(unpacked(part.column("vector")), *(part.column(c).to_numpy() for c in ("row", "id", "label")))
            held, count = [], 0

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("block", "strip", "side")]
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                now, its = (columns[0][low], columns[1][low]), int(columns[2][low])
                if (now, its) != (key, side):
                    flush()
                    if now != key and anchors is not None:
                        yield anchors.found()
                        anchors = None
                    key, side = now, its
                held.append(batch.slice(low, high - low))
                count += high - low
                if side == 1 and count >= HELD:
                    flush()
        flush()
        if anchors is not None:
            yield anchors.found()

    keys = ("block", "strip")
    got = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "cell").mapInArrow(run, "row long, slot int, scores array<long>, ids array<long>")
    best = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("minus"), p["ids"].alias("id")))
    got = got.groupBy("row", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(best))), 1, k).alias("best"))
    return got.select("row", "slot", F.transform("best", lambda p: F.struct((-p["minus"]).alias("score"), p["id"].alias("id"))).alias("best"))


class Miner:
    """The cleaned rows with their cells, and the searches over them."""

    def __init__(self, embeddings: DataFrame, vector: str, label: str, row_id: str, scale: int, sample: int):
        prepare(embeddings.sparkSession)
        self.spark = embeddings.sparkSession
        whole = F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * scale == float("inf")))
        scaled = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
        known = embeddings.where(whole).select(F.coalesce(F.col(row_id).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(F.col(label).cast("string")).alias("label"), scaled.alias("v"), "is_anchor")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = pa.array([packed(np.floor(np.array(v, np.float64))) for v in batch.column(2).to_pylist()], pa.binary())
                yield pa.record_batch([batch.column(0), batch.column(1), vectors, batch.column(3)], ["id", "label", "vector", "is_anchor"])

        packs = known.mapInArrow(pack, "id long, label long, vector binary, is_anchor boolean")
        rows = cut(packs.withColumn("row", F.monotonically_increasing_id()))
        n, anchors = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
        share = min(1.0, 2 * sample / max(1, n))
        some = rows if share == 1 else rows.where(F.xxhash64("row") < int(share * 2**64) - 2**63)
        drawn = some.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "id", "label", "vector").toArrow()
        self.drawn = (unpacked(drawn.column("vector")), *(drawn.column(c).to_numpy() for c in ("row", "id", "label")))
        level = lambda rows, most: int(np.clip(np.ceil(np.log2(max(1, rows) / most)), 0, DEPTH))
        splits = Splits.fit(self.drawn[0], level(n, CELL))
        self.coarse = splits.depth - min(level(anchors, BLOCK), splits.depth)
        self.strips = int(np.clip(n // STRIP, 1, STRIPS))
        own = splits.cells(self.drawn[0])
        centre = np.array([self.drawn[0][own == c].mean(0) if (own == c).any() else np.zeros(self.drawn[0].shape[1]) for c in range(2**splits.depth)])
        shared = self.spark.sparkContext.broadcast((splits, centre))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splits, centre = shared.value
            for batch in batches:
                x = unpacked(batch.column(2))
                cell = splits.cells(x)
                far = np.sqrt(((widened(x, centre.shape[1]) - widened(centre, x.shape[1])[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

        fields = "id long, label long, vector binary, is_anchor boolean, row long, cell int, far double"
        self.rows = cut(rows.mapInArrow(place, fields))
        radius = np.full(len(centre), -1.0)  # of cells without rows
        for r in self.rows.groupBy("cell").agg(F.max("far").alias("far")).collect():
            radius[r["cell"]] = r["far"]
        self.balls = Balls(centre, np.maximum(radius, 0) * (1 + 1e-9) + 1e-6)
        self.filled = radius >= 0

    def bounded(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """anchors with each slot's `low` raised to what the sample already has."""
        shared = self.spark.sparkContext.broadcast(self.drawn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, row, ids, label = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, GROUP):
                    part = pa.Table.from_batches([batch.slice(at, GROUP)]).combine_chunks()
                    own = Anchors(part, k, same)
                    own.meet(x, row, ids, label)
                    own.best.keep()
                    ends = np.concatenate(([0], np.cumsum(own.sizes))).astype(np.int32)
                    low = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.clip(own.best.low, LOW, HIGH).astype(np.int64)))
                    yield part.set_column(part.schema.get_field_index("low"), "low", low).to_batches()[0]

        return anchors.mapInArrow(run, anchors.schema) if len(self.drawn[1]) else anchors

    def blocks(self, anchors: DataFrame, same: bool) -> DataFrame:
        """anchors with block: those of a label (where only it matters) and of some cells, at most about BLOCK."""
        keys = ["label", "prefix"] if same else ["prefix"]
        anchors = anchors.withColumn("prefix", F.shiftright("cell", self.coarse))
        large = cut(anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"))
        anchors = anchors.join(maybe_broadcast(large), keys, "left")
        return anchors.withColumn("block", F.xxhash64(*keys, F.coalesce(F.expr("pmod(xxhash64(row), parts)"), F.lit(0)))).drop("prefix", "parts")

    def pairs(self, anchors: DataFrame) -> DataFrame:
        """block, label, cell: cells that may hold what a block's anchors need (label: of an anchor)."""
        shared = self.spark.sparkContext.broadcast((self.balls, self.filled))

        def meet(group: pa.Table) -> pa.Table:
            balls, filled = shared.value
            x = unpacked(group.column("vector"))
            lows, caps = (group.column(c).combine_chunks().flatten().to_numpy().astype(np.float64) for c in ("low", "cap"))
            least, most = Balls.of(x, [np.arange(len(x))]).interval(balls)
            able = filled & (most[0] >= lows.min(initial=np.inf)) & (least[0] <= caps.max(initial=-np.inf))
            cells = np.flatnonzero(able).astype(np.int32)
            return pa.table({"block": pa.array(np.repeat(group.column("block")[0].as_py(), len(cells)), pa.int64()), "label": pa.array(np.repeat(group.column("label")[0].as_py(), len(cells)), pa.int64()), "cell": cells})

        return anchors.select("block", "label", "vector", "low", "cap").groupBy("block").applyInArrow(meet, "block long, label long, cell int")

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """row, slot, best: for each slot of the anchors the k best rows, of the same label or of others."""
        anchors = cut(self.blocks(self.bounded(anchors, k, same), same))
        pairs = maybe_broadcast(cut(self.pairs(anchors).select("block", "cell", *["label"] * same)))
        none = F.lit(None).cast("array<long>")
        right = self.rows.join(pairs, ["cell", "label"] if same else ["cell"])
        right = right.select("block", F.expr(f"cast(pmod(xxhash64(row), {self.strips}) as int)").alias("strip"), F.lit(1).alias("side"), "cell", "row", "id", "label", "vector", none.alias("low"), none.alias("cap"))
        left = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(self.strips - 1))).alias("strip"), F.lit(0).alias("side"), "cell", "row", "id", "label", "vector", "low", "cap")
        return search(left.unionByName(right), k, same)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vector: str = "embedding", label: str = "label", row_id: str = "vec_id", scale: int = 256, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each anchor and positive.

    Components x become floor(scale * x); a score is the inner product, exact below 2**53 (beyond, as doubles round it). An anchor's
    positives are its best other rows of the same label; a positive's negatives are the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score (0 <= low < high, so none for a negative score), ranked
    from 1. Ties go to the smaller id, null ids last. Rows with a null label or vector, or a null or non-finite component, take no part.
    Vectors may differ in length: missing components count 0. Rows of equal ids are rows of their own (an anchor that occurs
    twice has its results twice, and each is a row for the other); a null id is an anchor only if is_anchor says so. Other
    columns are not read; an empty table, or no anchor, gives an empty result. sample: rows that the splits are fitted to.
    """
    embeddings = embeddings.select(F.col(row_id).alias("id of row"), F.col(label).alias("its label"), F.col(vector).alias("its vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    miner = Miner(embeddings, "its vector", "its label", "id of row", scale, sample)
    whole = lambda n: F.array(F.lit(n).cast("long"))
    anchors = miner.rows.where("is_anchor").select("row", "id", "label", "vector", "cell")
    first = miner.best(anchors.withColumns({"low": whole(LOW), "cap": whole(HIGH)}), positives, True)
    found = first.select("row", F.filter("best", lambda p: p["score"] >= 0).alias("best"))
    seen = cut(anchors.join(found, "row").where(F.size("best") > 0))
    window = {"low": F.transform("best", lambda p: _div(p["score"] * low + 99)), "cap": F.transform("best", lambda p: _div(p["score"] * high))}
    second = miner.best(seen.withColumns(window).drop("best"), negatives, False)
    named = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c)).alias
    out = second.join(seen.select("row", F.col("id").alias("anchor"), F.col("best").alias("positives")), "row")
    out = out.select("anchor", F.get("positives", F.col("slot")).alias("p"), F.posexplode("best").alias("at", "n"))
    out = out.select("anchor", F.col("p.id").alias("positive"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))
    return out.select(named("anchor")("anchor_id"), named("positive")("positive_id"), "rank", named("negative")("negative_id"), "positive_score", "negative_score")


def _div(x: Column) -> Column:
    """A whole hundredth, rounded down, of a number that is not negative; in integers."""
    return F.floor((x - x % 100) / 100)
