"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.llm import catalog, common, exact_dedup, ngram_jaccard, substring_dedup
from tonemill.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(sets):
    inverted, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        counts = defaultdict(int)
        for g in sets[d]:
            for e in inverted[g]:
                counts[e] += 1
            inverted[g].append(d)
        for e, c in counts.items():
            if 100 * c >= 75 * (len(sets[d]) + len(sets[e]) - c):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d in sets}


def windows(docs):
    first, out = {}, {}
    split = {d: (t or "").encode().split() for d, t in docs.items()}
    for d in sorted(split):
        for i in range(len(split[d]) - 12):
            first.setdefault(tuple(split[d][i : i + 13]), d)
    for d, w in split.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[d] = (len(w), len(gone), b" ".join(kept).decode())
    return out


def test_jaccard_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {d: shingles(t) for d, t in docs.items()}
    want = roots(sets)
    got = catalog.op10_ngram_jaccard(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}


def near_copies(seed=2, n=60):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 400, 200)]
    rows = []
    for i in range(n):
        w = list(base)
        for j in rng.integers(0, 200, rng.integers(0, 9)):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    return rows


def linked(rows):
    """All pairs of rows, by place, that link: by brute force."""
    sets = [shingles(t) for _, t in rows]
    return {(i, j) for j in range(len(rows)) for i in range(j) if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}


@pytest.mark.parametrize(("heavy", "block"), [(2, 1024), (10**6, 1024), (8, 16)])
def test_jaccard_returns_all_links(spark, monkeypatch, heavy, block):
    """All links and each row's number of them, with copies and small sets, whatever is heavy and however small blocks are."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", block)
    rows = near_copies() + [(300 + i, t + " more" * (i % 3)) for i, t in near_copies(9, 40)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, "a b c d e f g h"), (201, "a b c d e f g h i"), (202, "A b"), (203, "a b"), (204, ""), (205, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    documents = {r["doc_id"]: r for r in ngram_jaccard.similar_documents(docs, heavy=heavy).collect()}
    want, degree, least = linked(rows), defaultdict(int), roots({d: shingles(t) for d, t in rows})
    for pair in want:
        for i in pair:
            degree[rows[i][0]] += 1
    pairs = [tuple(sorted(documents[rows[i][0]]["class_id"] for i in pair)) for pair in want]
    assert len(documents) == len(rows)
    assert {d: (r["n_links"], r["component_id"]) for d, r in documents.items()} == {d: (degree[d], least[d]) for d, _ in rows}
    found = sorted((r["a"], r["b"]) for r in ngram_jaccard.similar_pairs(docs, heavy=heavy).collect())
    assert found == sorted({p for p in pairs if p[0] != p[1]})


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_of_random_sets(spark, seed):
    """Sets of all sizes that share parts, around the threshold."""
    rng = np.random.default_rng(seed)
    parts = [[f"p{k}_{j}" for j in range(rng.integers(3, 40))] for k in range(12)]
    rows = [(i, " ".join(w for k in sorted(rng.choice(12, rng.integers(1, 9), replace=False)) for w in parts[k])) for i in range(150)]
    want, degree, least = linked(rows), defaultdict(int), roots({d: shingles(t) for d, t in rows})
    for pair in want:
        for i in pair:
            degree[i] += 1
    got = ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), heavy=5).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == {d: (degree[d], least[d]) for d, _ in rows}


def test_jaccard_tells_rows_apart(spark):
    """One id with two texts, null ids with a group of their own, and repeated rows."""
    base = [t for _, t in near_copies(3, 6)]
    near = base[0] + " z"
    rows = [(7, base[0]), (7, "q " * 40), (9, near), (None, base[0]), (None, "n1 n2 n3 n4 n5 n6"), (None, "n1 n2 n3 n4 n5 n6"), (9, near)]
    got = sorted(ngram_jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert sorted(((r["doc_id"], r["component_id"], r["n_links"]) for r in got), key=str) == sorted([(7, 7, 3), (7, 7, 0), (9, 7, 3), (9, 7, 3), (None, 7, 3), (None, None, 1), (None, None, 1)], key=str)


def test_bands_and_prefixes():
    n = np.arange(1, 3000)
    band = ngram_jaccard.band_of(n)
    for a in range(1, 600):
        b = np.arange(a, 4 * a // 3 + 1)
        assert (band[b - 1] - band[a - 1] <= 1).all()
        o = -(-3 * (a + b) // 7)
        assert (a - o + 1 <= ngram_jaccard.lower_prefix_length(np.int64(a))).all()
        assert (b - o + 1 <= ngram_jaccard.prefix_length(b)).all()


def test_parities_bound_the_distance():
    """Of sets of all sizes, folded or not: never more apart than the sets are, and unlike ones are told apart."""
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 40_000, dtype=np.uint64)
    sets = [np.unique(pool[k : k + n]) for k, n in ((0, 3), (1, 3), (0, 700), (50, 900), (0, 9000), (100, 9500), (20_000, 9000), (0, 12_000))]
    blobs = ngram_jaccard.parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets))
    assert [8 * len(x) for x in blobs] == ngram_jaccard.parity_bits(np.array([len(x) for x in sets])).tolist()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = ngram_jaccard.folded([blobs[i], blobs[j]])
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))
    x, y = ngram_jaccard.folded([blobs[4], blobs[6]])
    assert int(np.bitwise_count(x ^ y).sum()) > 18_000 / 7


def test_jaccard_edges(spark, edge_docs, no_docs):
    found = ngram_jaccard.similar_documents(edge_docs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert {(1, 76, 1), (2, 76, 1), (3, 76, 1), (4, 0, 4), (5, 0, 5), (9, 1, 9), (10, 1, 9), (14, 1, 14), (None, 76, 1)} <= got
    assert found.count() == edge_docs.count()
    assert ngram_jaccard.similar_documents(no_docs).count() == 0


def test_substring_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = windows(docs)
    for r in catalog.op5_substring_dedup(spark, sf).collect():
        n, gone, text = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_substring_common_passage(spark, monkeypatch):
    """A passage in most documents goes without its places, over several shares of several tasks."""
    monkeypatch.setattr(substring_dedup, "HELD", 30)
    rng = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"u{i}_{j}" for j in rng.integers(0, 50, 20)) + " " + passage + f" tail{i}") for i in range(40)]
    want = windows(dict(rows))
    for parts in (1, 3):
        got = substring_dedup.without_repeats(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(parts)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_substring_common_grams(spark, monkeypatch):
    """Few words, so that nearly all grams are common: windows differ although their grams do not; a bound on a minimiser's documents."""
    monkeypatch.setattr(substring_dedup, "HELD", 200)
    rng = np.random.default_rng(2)
    whole = [" ".join(f"w{j}" for j in rng.integers(0, 3, 60)) for _ in range(60)]
    rows = [(i, whole[int(rng.integers(0, 60))] + " " + whole[int(rng.integers(0, 60))][: int(rng.integers(30, 90))]) for i in range(90)]
    want = windows(dict(rows))
    for most in (10, substring_dedup.MOST):
        monkeypatch.setattr(substring_dedup, "MOST", most)
        got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want


def test_substring_edges(spark, edge_docs, no_docs):
    rows = {r["doc_id"]: r["text"] for r in edge_docs.where("doc_id is not null").collect()}
    want = windows(rows)
    got = substring_dedup.without_repeats(edge_docs).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_sliding_least_and_sets():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    for more in range(12):
        assert substring_dedup.sliding_least(key, more).tolist() == [min(key[i : i + more + 1].tolist()) for i in range(50 - more)]
    known = np.sort(np.append(key[::3], np.uint64(0xFFFFFFFFFFFFFFFF)))
    assert substring_dedup.in_set(key, known).tolist() == np.isin(key, known).tolist()
    assert not substring_dedup.in_set(key, known[:0]).any()


def test_window_hash_collisions():
    """Windows with equal hashes and other bytes are told apart."""
    text = b"aa bb cc"
    low, high = np.array([0, 3, 6, 0]), np.array([2, 5, 8, 2])
    same = np.zeros(4, np.uint64)
    assert substring_dedup.earliest(same, np.array([5, 3, 4, 2]), text, low, high).tolist() == [2, 3, 4, 2]


def test_exact_edges(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(edge_docs).collect()}
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = edge_docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r["text"])].append(r["doc_id"])
    for r in rows:
        ids = groups[plain(r["text"])]
        own = got[r["doc_id"]]
        assert own["group_size"] == len(ids)
        assert own["keep_id"] == min(i for i in ids if i is not None)
        assert own["text_sha256"] == hashlib.sha256(plain(r["text"]).encode()).hexdigest()
        assert own["kept"] == (r["doc_id"] == own["keep_id"])
    assert exact_dedup.exact_groups(no_docs).count() == 0


@pytest.mark.parametrize("skip", [0, 2, 7])
def test_quotient_filters_merge_without_loss(monkeypatch, skip):
    """Filters of several sizes, with large counts, an empty stretch and a run of many, packed and merged."""
    monkeypatch.setattr(exact_dedup, "RANGE", 64)
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2 ** (64 - skip), 3000, dtype=np.uint64)
    values[:1000] = values[1000:2000]
    values[2500:2900] = np.uint64(12345)
    values[2900:2950] = np.arange(50, dtype=np.uint64)
    parts = []
    for own in (values[:700], values[700:710], values[710:2890], values[2890:]):
        own, counts = np.unique(own, return_counts=True)
        packed = exact_dedup.Filter.build(own, counts, skip).pack()
        assert len(packed) < 12 * len(own) + 40
        part = exact_dedup.Filter.unpack(packed)
        assert np.array_equal(part.entries()[0], own) and np.array_equal(part.entries()[1], counts)
        parts.append(part)
    whole = exact_dedup.merge_filters(parts)
    want, counts = np.unique(values, return_counts=True)
    assert np.array_equal(whole.entries()[0], want) and np.array_equal(whole.entries()[1], counts)
    block = 1 if skip else 0
    assert np.array_equal(whole.prints(block), want + np.uint64(block << (64 - skip) if skip else 0))


def test_exact_hot_groups(spark, monkeypatch, edge_docs):
    """Groups that are broadcast give the same as those that are shuffled."""
    cold = sorted(map(str, exact_dedup.exact_groups(edge_docs).collect()))
    monkeypatch.setattr(exact_dedup, "HOT_GROUP", 3)
    assert sorted(map(str, exact_dedup.exact_groups(edge_docs).collect())) == cold


def test_colliding_fingerprints(spark, monkeypatch):
    """Texts of one fingerprint are told apart by their bytes."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 6), (3, 1), (None, 1), (20, 19), (19, 18), (18, 17), (17, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 17: 4, 18: 4, 19: 4, 20: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_taken_out(spark, edge_docs):
    gone = edge_docs.where("doc_id in (1, 14) or doc_id is null").select("doc_id", common.row_key().alias("h")).union(spark.createDataFrame([(2, 0)], "doc_id long, h long"))
    left = common.without_rows(edge_docs, gone)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in edge_docs.where("doc_id is not null and doc_id not in (1, 14)").collect())
    assert left.columns == edge_docs.columns
