"""Suffix-tree scores, importance resampling and hard negatives, against plain Python and SQL, and on edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.llm import catalog, hard_negatives, importance, suffix_tree
from tonemill.llm.common import crc_mod


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", lower), None]


class PlainTree:
    """The suffix tree by dictionaries; symbols are words, "<rare>" and None (the end)."""

    def __init__(self, texts, depth, discount, divergence):
        self.words = Counter(w for t in texts for w in tokens(t)[:-1])
        self.rare = {w for w, n in self.words.items() if n < 2}
        self.total, self.depth = sum(self.words.values()) + len(texts), depth
        self.texts, counts, follow = len(texts), Counter(), [Counter() for _ in range(depth + 1)]
        rows = [self.framed(t) for t in texts]
        for row in rows:
            counts.update(row[1:])
        self.root = lambda s: (counts[s] + 1) / (self.total + len(self.words) - len(self.rare) + 2)
        for row in rows:
            for i in range(1, len(row)):
                for k in range(1, min(depth, i) + 1):
                    follow[k][row[i - k : i], row[i]] += 1
        self.next, self.rest, kept, totals = [{}], [{}], None, {(s,): n for s, n in counts.items()}
        marked = [set()]
        for k in range(1, depth + 1):
            nexts, rest, retained = defaultdict(dict), {}, set()
            for (context, s), n in follow[k].items():
                if n >= 2 and (kept is None or context in kept):
                    nexts[context][s] = n
            self.next.append(nexts), self.rest.append(rest)
            for context, of in nexts.items():
                total = totals[context]
                rest[context] = (total - sum(of.values()) + discount * len(of)) / total
                below = {s: self.share(context[1:], s) for s in of}
                self.next[k][context] = {s: max(n - discount, 0) / total + rest[context] * below[s] for s, n in of.items()}
                gain = sum(n * math.log(self.next[k][context][s] / below[s]) for s, n in of.items()) + (total - sum(of.values())) * math.log(rest[context])
                if (gain - len(of)) / total >= divergence:
                    retained.add(context)
            marked.append(retained)
            totals = {(*context, s): n for (context, s), n in follow[k].items() if n >= 2 and (kept is None or context in kept) and s is not None}
            kept = set(totals)
        for k in range(depth, 1, -1):
            marked[k - 1] |= {c[1:] for c in marked[k]}
        for k in range(1, depth + 1):
            self.next[k] = {c: v for c, v in self.next[k].items() if c in marked[k]}

    def framed(self, text):
        return (None, *("<rare>" if w is not None and (w in self.rare or w not in self.words) else w for w in tokens(text)))

    def share(self, context, s):
        k = len(context)
        if not k:
            return self.root(s)
        if context not in self.next[k]:
            return self.share(context[1:], s)
        own = self.next[k][context]
        return own[s] if s in own else self.rest[k][context] * self.share(context[1:], s)

    def score(self, text):
        row, out = self.framed(text), 0.0
        for i in range(1, len(row)):
            out += math.log10(self.share(row[max(0, i - self.depth) : i], row[i]))
        share = lambda w: (self.words[w] + suffix_tree.PRIOR) / (len(self.rare) + suffix_tree.PRIOR * (len(self.rare) + 1))
        return out + sum(math.log10(share(w)) for w in tokens(text)[:-1] if w in self.rare or w not in self.words)

    def base(self, text):
        count = lambda w: self.texts if w is None else self.words[w]
        return sum(math.log10((count(w) + 1) / (self.total + len(self.words) + 2)) for w in tokens(text)), sum(count(w) > 0 for w in tokens(text))


def held_out(i, n=7, m=2):
    return zlib.crc32(str(i).encode()) % n == m


def test_suffix_tree_equals_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = PlainTree([t for i, t in texts.items() if not held_out(i)], 3, suffix_tree.DISCOUNT, suffix_tree.DIVERGENCE)
    assert any(len(c) == 3 for c in plain.next[3])
    got = suffix_tree.learn_and_score(docs, crc_mod(F.col("doc_id"), 7) != 2).collect()
    assert len(got) == len(texts)
    for r in got:
        base, known = plain.base(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(texts[r.doc_id])), known, plain.total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-9)


def test_suffix_tree_shares_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a b a c a b b a",), ("a b a c c b a",), ("b a b",), ("a b a b",)] * 3, "text string").withColumn("train", F.lit(True)).withColumn("doc_id", F.lit(1).cast("long"))
    words = suffix_tree.word_counts(docs)
    alphabet = suffix_tree.Alphabet.of(words, 12)
    tree = suffix_tree.fit_tree(suffix_tree.symbol_rows(docs, alphabet), alphabet, divergence=0.0)
    assert [len(x.contexts) > 0 for x in tree.levels] == [True, True, True]
    symbols = np.array([0, 1, 2, suffix_tree.RARE, suffix_tree.END], np.uint64)
    assert np.isclose(tree.root[symbols.astype(int)].sum(), 1)
    for k, level in enumerate(tree.levels, 1):
        for context in level.contexts:
            keys = (context << np.uint64(16)) | symbols
            shares = tree.shares([keys & np.uint64((1 << 16 * (m + 1)) - 1) for m in range(k)] + [keys] * (4 - k), np.full(5, k))
            assert np.isclose(shares.sum(), 1)


def test_held_out_text_is_better_than_the_base(spark):
    rows = [r for r in catalog.op11_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_suffix_tree_edges(spark, edge_docs, no_docs):
    got = suffix_tree.learn_and_score(edge_docs, F.col("doc_id") != 3).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == edge_docs.count() and by[11].n_tokens == 60_001
    assert {(by[i].n_tokens, round(by[i].score, 9)) for i in (4, 5, 6)} == {(1, round(by[4].score, 9))}
    assert by[9].n_tokens == 4 and by[9].score == by[10].score and len({r.score for r in got if r.doc_id == 14}) == 1
    assert all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert suffix_tree.learn_and_score(no_docs, F.lit(True)).count() == 0
    untrained = suffix_tree.learn_and_score(edge_docs, F.lit(None).cast("boolean")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untrained} == {(0, 0, 0.0)}


def plain_resample(docs, items, high, buckets, share, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in runs]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for r in made for b in r[2]), Counter(b for x in items for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, n, of in made:
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of)
        rows.append((i, n, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {r: k for k, r in enumerate(able[: share * len(able) // 100], 1)}
    return [(i, n_of, w, sc, drawn.get((i, n, n_of, w, sc))) for i, n, n_of, w, sc in rows]


@pytest.mark.parametrize("high", [1, 3])
def test_resampling_equals_plain_python(spark, sf, high):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = importance.resample(docs, items, 1, high, 997, 20, 30).collect()
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], high, 997, 20, 30)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.rank is not None for r in got) > 10


@pytest.mark.parametrize("name", ["op12_importance", "op13_hard_negatives"])
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf)
    want = con.execute(catalog.oracle_sql()[name])
    assert [c[0] for c in want.description] == got.columns
    rows = want.fetchall()
    assert rows and sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.collect())


def test_resampling_edges(spark, edge_docs, no_docs):
    target = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    got = importance.resample(edge_docs, target, share=50, least_words=2, buckets=100).collect()
    want = plain_resample([(r.doc_id, r.text) for r in edge_docs.collect()], ["a b c"], 1, 100, 50, 2)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted((str(w[0]), *w[1:4]) for w in want)
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    able = 13  # of 16 rows those with two words or more
    assert [r.rank for r in drawn] == list(range(1, able // 2 + 1)) and [r.score for r in drawn] == sorted((r.score for r in drawn), reverse=True)
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(edge_docs, no_docs).count() == edge_docs.count()


def plain_mine(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector); null ids last among ties."""
    clean = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a, (i, lab, v) in enumerate(clean):
        if i is None or not is_anchor(i):
            continue
        others = [(j, dot(v, w), other == lab) for b, (j, other, w) in enumerate(clean) if b != a]
        for p, ps, _ in sorted((r for r in others if r[2]), key=order)[:positives]:
            near = sorted((r for r in others if not r[2] and low * ps <= 100 * r[1] <= high * ps), key=order)[:negatives]
            out += [(i, p, k, j, ps, s) for k, (j, s, _) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_mining_equals_plain_python(spark, monkeypatch, seed):
    """Many blocks, cells and strips; clusters, copies, ties and vectors of several lengths."""
    for name, value in {"BLOCK": 8, "CELL": 16, "STRIP": 60, "SAMPLE": 50}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, 5))
    rows = []
    for i in range(400):
        label = int(rng.integers(0, 4)) if i % 11 else 1
        v = [0.1, 0.2, 0.1, 0.3, 0.1] if i % 5 == 0 else (centres[rng.integers(0, 6)] + rng.normal(0, 0.1, 5)).tolist()
        rows.append((i, label, v[: 5 - (i % 17 == 0)]))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, sample=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain_mine(rows, lambda i: i % 10 == 0)) and len(got) > 500


def test_intervals_hold():
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (60, 7)), rng.normal(0.5, 2, (80, 7))
    parts, others = hard_negatives.halves(x, 9), hard_negatives.halves(y, 13)
    assert sorted(np.concatenate(parts).tolist()) == list(range(60)) and max(map(len, parts)) <= 9
    least, most = hard_negatives.Balls.of(x, parts).interval(hard_negatives.Balls.of(y, others))
    for i, p in enumerate(parts):
        for j, q in enumerate(others):
            s = x[p] @ y[q].T
            assert least[i, j] <= s.min() and s.max() <= most[i, j]


def test_mining_edges(spark):
    one = [0.5, 0.25]
    rows = [(0, 1, one), (0, 1, one), (1, 1, one), (2, 2, [0.4, 0.2]), (3, None, one), (4, 2, None), (5, 2, [0.4, None]), (6, 2, [float("nan"), 0.1]), (7, 2, [float("inf"), 0.1]), (None, 2, [0.3, 0.2]), (8, 3, []), (9, 2, [300.0, -299.0]), (100, 2, [0.3, 0.1, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, row int, cell string")
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect()]
    want = plain_mine(rows, lambda i: i % 100 == 0)
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") < 0).count() == 0
