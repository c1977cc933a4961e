"""Classifiers by held-out accuracy, decontamination, token counts, licences and urls by brute force."""

import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.llm import catalog, decontamination, language, license_scan, quality, token_counts, url_filters
from tonemill.llm.hashed import counts_of


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = [r for r in catalog.op1_quality(spark, small).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(got) > 40
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.93
    assert np.mean([r["predicted"] for r in got if labels[r["doc_id"]] == 1]) > 0.97


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (8, None), (11, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(edge_docs, labels)
    rows = quality.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert quality.score(no_docs, model).count() == 0
    assert quality.keep_good(edge_docs, model).columns == edge_docs.columns
    assert {r["score"] for r in quality.score(edge_docs, quality.fit(no_docs, labels)).collect()} == {0.5}


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    counts, labels = rng.poisson(0.05, (90, quality.DIMS)).astype(np.float32), rng.integers(0, 2, 90)
    model = quality.fit_arrays(counts, labels.astype(float), rank=8)
    z = model.embed(counts[:5])
    for row, score in zip(z, model.scores(counts[:5]), strict=True):
        cosine = np.round(model.vectors @ row, 5)
        near = sorted(range(90), key=lambda i: (-cosine[i], i))[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 0) ** quality.POWER
        assert score == pytest.approx(((w * labels[near]).sum() + 1e-3 * labels.mean()) / (w.sum() + 1e-3), abs=1e-3)


def test_language_held_out(spark, small):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in catalog.op8_language(spark, small).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge_docs, no_docs):
    model = language.fit(edge_docs)
    got = {r["doc_id"]: r for r in language.identify(edge_docs, model).collect()}
    for i in (4, 5, 6, 13):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1]["lang_pred"] in model.languages
    assert language.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge_docs, language.fit(no_docs)).collect()} == {"und"}


def test_counts_in_parts(monkeypatch):
    texts = [b"abc", b"", b"x", b"long text " * 30, "é".encode()]
    whole = counts_of(texts, 64)
    monkeypatch.setattr("tonemill.llm.hashed.BYTES", 17)
    np.testing.assert_array_equal(counts_of(texts, 64), whole)
    assert whole.sum(1).tolist() == [3, 0, 1, 300, 2]


@pytest.mark.parametrize("length", range(1, 15))
def test_masks_miss_no_window(length):
    """Whatever words are substituted: a mask fits in each window that counts as a leak."""
    size, need = decontamination.window_of(length)
    masks = [decontamination.MASKS[k] for k in decontamination.masks_of(np.array([length]))]
    for gone in itertools.combinations(range(size), size - need):
        left = set(range(size)) - set(gone)
        assert any(all(s + o in left for o in m) for m in masks for s in range(size - m[-1]))


def plain(text):
    return re.sub(r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", " ", (text or "").lower()).split()


def brute_leaks(docs, items):
    """(doc, item): most words that agree in any window, by comparing all alignments."""
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in plain(t)], np.int64)
    coded, out = {i: code(t) for i, t in items}, {}
    for d, text in docs:
        own = code(text)
        for i, item in coded.items():
            size, need = min(13, len(item)), -(-3 * min(13, len(item)) // 4) if len(item) >= 8 else len(item)
            if not size or len(own) < size:
                continue
            padded = np.concatenate([np.full(len(item), -1), own, np.full(len(item), -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
            real = np.lib.stride_tricks.sliding_window_view(padded, len(item)) >= 0
            agree = np.lib.stride_tricks.sliding_window_view(same, size, axis=1).sum(-1)
            agree[np.lib.stride_tricks.sliding_window_view(real, size, axis=1).sum(-1) < size] = -1
            if agree.max() >= need:
                out[d, i] = int(agree.max())
    return out


def test_leaks_by_brute_force(spark, sf):
    """Planted items with substitutions of every kind, of all lengths, among plain documents."""
    rng = np.random.default_rng(8)
    base = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    items = [(i, " ".join(f"k{x}" for x in rng.integers(0, 60, n))) for i, n in enumerate([*range(1, 16), 25, 40, 8, 12, 13])]
    items += [(100, "same " * 30), (101, " ".join(plain(base[3])[:20]))]
    docs = []
    for d, text in enumerate(base):
        own, (_, item) = plain(text), items[int(rng.integers(len(items)))]
        words = item.split()
        for j in rng.integers(0, len(words), rng.integers(0, 5)):
            words[j] = "subst"
        at = int(rng.integers(0, len(own) + 1))
        docs.append((d, " ".join([*own[:at], *words[int(rng.integers(0, 3)) :], *own[at:]])))
    docs += [(1000, "same " * 5000), (1001, "same"), (1002, "x " + "same " * 13)]
    want = brute_leaks(docs, items)
    for size in (10**6, 100):
        got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=size).collect()
        assert {(r["doc_id"], r["item_id"]): r["agree"] for r in got} == want
    assert len(want) > 80


def test_leaks(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, " ".join(f"r{i}" for i in range(9))), (3, "Too short, item"), (4, None), (None, "x " * 20), (6, "!")]
    noise = " ".join(f"n{i}" for i in range(50))
    q = items[0][1].split()
    changed = list(q)
    changed[3] = changed[8] = changed[13] = "sub"
    docs = [(1, f"{noise} {items[0][1]} {noise}"), (2, f"{noise} {' '.join(changed).upper()} {noise}"), (3, f"{noise} {' '.join(q[:6])} {noise}"), (4, f"{noise} {items[1][1]}!"), (5, None), (6, ""), (7, " ".join(q[4:17])), (None, items[0][1]), (8, "a too short item"), (8, "another text"), (None, "clean")]
    own = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_ids"], r["contaminated"]) for r in decontamination.contaminated(own, benchmark).collect()), key=str)
    want = [(1, [1]), (2, [1]), (3, []), (4, [2]), (5, []), (6, []), (7, [1]), (None, [1]), (8, [3]), (8, []), (None, [])]
    assert got == sorted(((d, i, bool(i)) for d, i in want), key=str)
    left = decontamination.keep_clean(own, benchmark).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted((d or 0, t or "") for (d, t), (_, i) in zip(docs, want, strict=True) if not i)


def test_leaks_in_blocks(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole, parts = (decontamination.leaks(docs, items, block_words=n) for n in (10**6, 300))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    verbatim = {(d, i["item_id"]) for d, t in texts.items() for i in items.collect() if i["text"] in (t or "")}
    assert verbatim and verbatim <= {(r["doc_id"], r["item_id"]) for r in whole.collect()}


def test_leak_edges(spark, edge_docs, no_docs):
    items = edge_docs.where("doc_id = 1").select(F.lit(5).alias("item_id"), "text")
    rows = decontamination.contaminated(edge_docs, items).collect()
    got = {r["doc_id"]: r["item_ids"] for r in rows}
    assert got[1] == got[2] == got[3] == got[None] == [5]
    assert got[4] == got[5] == got[11] == []
    assert len(rows) == edge_docs.count()
    assert decontamination.contaminated(no_docs, items).count() == 0
    assert decontamination.contaminated(edge_docs, items.limit(0)).where("contaminated").count() == 0


def brute_tokens(word, scores):
    marked = "▁" + word
    best = [(0.0, 0)]
    for end in range(1, len(marked) + 1):
        own = len(marked[end - 1].encode())
        options = [(best[end - 1][0] + token_counts.BYTE_SCORE * own, -(best[end - 1][1] + own))]
        options += [(best[s][0] + scores[marked[s:end]], -(best[s][1] + 1)) for s in range(end) if marked[s:end] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark, sf):
    scores = token_counts.vocabulary(token_counts.piece_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(25)
    memo = {}
    for r in token_counts.token_counts(docs).join(docs, "doc_id").collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        want = sum(memo.setdefault(w, brute_tokens(w, scores)) for w in words)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), want)


def test_token_count_edges(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in token_counts.token_counts(edge_docs).collect()}
    assert got[4]["n_tokens"] == got[5]["n_tokens"] == got[6]["n_tokens"] == 0
    assert got[12]["n_tokens"] >= 3
    assert token_counts.token_counts(no_docs).count() == 0
    counter = token_counts.Counter({"▁": -1.0, "▁a": -2.0, "b": -2.0, "ab": -1.5, "▁ab": -4.0}, limit=2)
    assert counter.totals(["ab a", "ab ab b", None]) == ([2, 3, 0], [3, 6, 0])
    assert math.isclose(sum(counter.scores.values()), -10.5)


def test_licences(spark, edge_docs, no_docs):
    mit = license_scan.KNOWN[0][1]
    docs = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;")), (2, "text\nReleased under the MIT Licence!\nmore"), (3, None), (4, mit + " and more"), (5, "released  under the mit license")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["text_license"] == "MIT"
    assert (got[2]["text_license"], got[2]["line_licenses"], got[2]["n_license_lines"]) == (None, ["MIT"], 1)
    assert got[3]["text_license"] is None and got[4]["text_license"] is None
    assert got[5]["text_license"] == "MIT"
    assert license_scan.scan(edge_docs).count() == edge_docs.count()
    assert license_scan.scan(no_docs).count() == 0


def test_whole_licences(spark):
    """Whole texts of common licences, as files usually hold them: title, copyright line, reservation, other spellings."""
    whole = {w: (license_scan.files("tonemill.llm") / "licenses" / f"{w}.txt").read_text(encoding="utf-8") for w in license_scan.WHOLE}
    mit = license_scan.KNOWN[0][1]
    cases = list(whole.items()) + [
        ("MIT", "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), ("MIT", "The MIT License (MIT)\nCopyright (c) 2020 Someone\nAll rights reserved.\n" + mit), ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + whole["BSD-2-Clause"]),
        ("BSD-3-Clause", whole["BSD-3-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")), ("Apache-2.0", whole["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", whole["GPL-3.0"].replace("https:", "http:").replace("organization", "organisation")),
        (None, "MIT License"), (None, whole["GPL-2.0"][:9000]), (None, whole["Unlicense"] + "but not on Sundays"),
    ]
    got = {r["doc_id"]: r["text_license"] for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_urls(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    pages = [
        (1, "http://a.example.net/fr/x", ""), (2, "http://b.example.org/1", link.format("http://a.example.net/fr/x")), (3, "http://c.example.org/2", '<meta http-equiv="refresh" content="0; url=http://b.example.org/1">'),
        (4, "http://WWW.Example.com/en/a", link.format("http://a.example.net/fr/x")), (5, "http://example.com/en/a?q", None), (6, "http://example.com", ""), (7, None, link.format("http://a.example.net/fr/x")), (8, "no scheme", ""), (9, "http://lone.example.org/", ""),
        (9, "http://lone.example.org/", ""), (10, "http://notexample.com/en/", ""),
    ]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: (r["verdict"], r["rule"]) for i, r in got.items()} == {
        1: ("block", "net/fr/"), 2: ("block", None), 3: ("block", None), 4: ("allow", "www.example.com/en/"), 5: ("block", "example.com/en/"), 6: ("allow", None), 7: ("allow", None), 8: ("allow", None), 9: ("allow", None), 10: ("allow", "com/"),
    }
    assert (got[4]["host"], got[5]["path"], got[7]["host"], got[8]["path"]) == ("www.example.com", "/en/a", "", "")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(empty).count() == 0


def test_url_links_of_every_form(spark):
    """Relative targets, tags after the first, &amp; and base tags lead to the blocked page as absolute urls do."""
    to = lambda x: f'<link rel="canonical" href="{x}">'
    cases = {
        "http://a.example.net/1": '<meta http-equiv="refresh" content="0; url=/fr/home">', "http://a.example.net/2": to("//a.example.net/fr/home"), "http://a.example.net/es1/x?q": to("../fr/home"),
        "http://a.example.net": to("fr/./home"), "http://a.example.net/5": to("http://c.example.org/") + to("/fr/home"), "http://a.example.net/6": '<meta http-equiv=refresh content="5">' + '<meta http-equiv=refresh content="0;url=/fr/home">',
        "http://b.example.org/7": '<base href="http://a.example.net/fr/">' + to("home"), "http://a.example.net/8": to("/q?a=1&amp;b=2"), "http://a.example.net/q?a=1&b=2": to("/fr/home"),
    }
    clear = {"http://a.example.net/c1": to("#fr"), "http://a.example.net/c2": to("mailto:fr/home"), "http://d.example.org/c3": to("/r?to=http://a.example.net/fr/home"), "no scheme": to("/fr/home"), "http://a.example.net/c5": None}
    pages = [(i, u, h) for i, (u, h) in enumerate({**cases, **clear}.items())]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {u: got[i] for i, u, _ in pages} == dict.fromkeys(cases, "block") | dict.fromkeys(clear, "allow")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    got = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(r) for r in got.fetchall())
