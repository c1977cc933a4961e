"""Hand-made values of the text functions, scorers and segmenters."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.models import stem
from tonemill.operators import segment as G
from tonemill.operators import vectors as V


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "terms", "raw"),
    [("violations", L.CRITICISM_HARD, 2), ("needs to be", L.CRITICISM_SOFT, 3), ("limited progress", L.CRITICISM_SOFT, 2), ("", L.CRITICISM_HARD, 0), ("Industrial", ("trial",), 1)],
)
def test_raw_counts(spark, text, terms, raw):
    assert one(spark, text, lambda t: S.raw_count(t, terms)) == raw


def test_rates_and_ratio(spark):
    assert one(spark, "needs to be", lambda t: S.dict_score(t, L.CRITICISM_SOFT)) == 1000.0
    assert one(spark, "", lambda t: S.dict_score(t, L.CRITICISM_SOFT)) == 0.0
    row = spark.createDataFrame([("failed",), ("failed issue",)], "t string").select(S.severity(S.dict_score(F.col("t"), L.CRITICISM_HARD), S.dict_score(F.col("t"), L.CRITICISM_SOFT)).alias("r")).collect()
    assert [r["r"] for r in row] == [None, 1.0]


def test_topics_and_progress(spark):
    assert one(spark, "industrial", lambda t: S.topic_flags(t, L.TOPICS_FOUR)["topic_judiciary"]) is True
    assert one(spark, "very good progress", lambda t: S.progress(t, L.PROGRESS_SCALE)["progress_mentions"]) == 2
    assert one(spark, "very good progress", lambda t: S.progress(t, L.PROGRESS_SCALE)["progress_score_norm"]) == 2.5


@pytest.mark.parametrize(("text", "words"), [("", 0), ("  a b\tc ", 3), ("one", 1)])
def test_word_count(spark, text, words):
    assert one(spark, text, X.word_count) == words


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("One two.  \nThree four.", ["One two.", "Three four."]),
        ("Word. \nNext", ["Word.", "Next"]),
        ("Mr. \nSmith", ["Mr.  Smith"]),
        ("Word. \nAbcd. \nX", ["Word.", "Abcd.", "X"]),
        ("a===== PAGE 3 =====b", ["ab"]),
    ],
)
def test_paragraphs(spark, text, parts):
    assert one(spark, text, G.paragraph_list) == parts


def test_split_long(spark):
    assert one(spark, "a b. c d e. f.", lambda t: G.split_long(t, 4)) == ["a b. c d e.", "f."]


def test_file_names(spark):
    names = ["north_macedonia_2024_raw.txt", "kosovo_raw.txt"]
    got = spark.createDataFrame([(n,) for n in names], "t string").select(*(c.alias(n) for c, n in zip(G.parse_filename(F.col("t")), "cy", strict=True))).collect()
    assert [tuple(r) for r in got] == [("North Macedonia", 2024), (None, None)]


def test_clean_text(spark):
    text = "===== PAGE 2 =====\nChapter 23: Judiciary\n1.1. CONTEXT\n 12 \nKosovo2 has → Adopted laws.\nTHE FUNDAMENTALS OF THE PROCESS\n"
    assert one(spark, text, X.clean_text) == "kosovo has adopted laws."
    report = one(spark, text, X.cleaning_report)
    assert report["final_words"] == 4
    assert report["total_removed"] == report["raw_words"] - 4


def test_line_ends(spark):
    assert one(spark, "Chapter 1 x\r\nkept", X.clean_text) == "kept"


def test_labels(spark):
    assert one(spark, "It has adopted; needs to act", X.classify_sentence) == "Action_Status"
    assert one(spark, "It needs to act", X.classify_sentence) == "Intention_Requirement"
    assert one(spark, "Cluster 2 after Chapter 23", X.anchor_topic) == "internal_market"
    assert one(spark, "1. Text", X.drop_leading_number) == "Text"
    assert one(spark, "Côte d'Ivoire -  Nord", X.slugify) == "cote-divoire-nord"


def test_sentences(spark):
    text = "This sentence has more than twenty chars. It cites Art. Seven of the act in full. Short. And here is another sentence of length."
    got = one(spark, text, G.sentences)
    assert got == ["This sentence has more than twenty chars.", "It cites Art. Seven of the act in full.", "And here is another sentence of length.."]


def test_labelled_paragraphs(spark):
    text = "===== PAGE 1 =====\n1.1 CONTEXT\nfirst line of a body\n12\nthat goes on here\n\nsecond body line is long enough to stay in\n"
    rows = G.labelled_paragraphs(spark.createDataFrame([(1, text)], "id long, text string"), "id", min_words=2).orderBy("position").collect()
    assert [(r["is_header"], r["raw_text"]) for r in rows] == [(True, "1.1 CONTEXT"), (False, "first line of a body that goes on here"), (False, "second body line is long enough to stay in")]


def test_vocabulary(spark):
    got = one(spark, "a b a c", lambda t: S.vocabulary(X.words(t)))
    assert (got["tokens"], got["types"], got["hapax"], got["ttr"]) == (4, 3, 2, 0.75)
    assert one(spark, "", lambda t: S.vocabulary(X.words(t)))["tokens"] is None


def test_ngrams(spark):
    assert one(spark, "ab cd ef", lambda t: G.ngrams(G.vector_tokens(t), 1, 2)) == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, "ab", lambda t: G.ngrams(G.vector_tokens(t), 2, 3)) == []


def test_section_cleaner(spark):
    text = "3\n1. INTRODUCTION1 Rules12 apply.\n 1.2. Main findings of the report\nCluster 2: Courts"
    assert one(spark, text, X.clean_section) == "rules apply. courts"


def test_slugs(spark):
    assert one(spark, " Đakovo_Ősz  ﬁ – Ａ!", X.slugify) == "akovo_osz-fi-a"


def test_sentences_after_abbreviations(spark):
    a = next(x for x in L.ABBREVIATIONS if x.isalpha())
    text = f"One saw {a}. Smith and {a}. {a.title()}. Jones. Two went on. Three"
    assert one(spark, text, lambda c: G.sentences(c, 1)) == [f"One saw {a}. Smith and {a}. {a.title()}. Jones.", "Two went on.", "Three."]
    assert one(spark, "", lambda c: G.sentences(c, 1)) == []


def test_alphabetic_tokens_and_stem_lists(spark):
    text = "The (Reports) were well-known, 3rd reports; reporting ABC that"
    assert one(spark, text, lambda c: G.alphabetic_tokens(c, 4, ("that",))) == ["reports", "were", "reports", "reporting"]
    assert one(spark, text, lambda c: stem.stem_lists(G.alphabetic_tokens(c, 4, ("that",)), stem.porter)) == ["report", "were", "report", "report"]


def test_pooled_ngrams(spark):
    """Runs across several short rows, against the joined tokens."""
    rows = [("a", 1, ["x", "y", "z"]), ("a", 2, ["u"]), ("a", 3, []), ("a", 4, ["v"]), ("a", 5, ["w", "x", "y", "z"]), ("b", 1, ["x"])]
    df = spark.createDataFrame(rows, "g string, i int, t array<string>")
    whole = [t for g, _, ts in rows if g == "a" for t in ts]
    for n in (2, 3, 4):
        want = Counter(" ".join(whole[i : i + n]) for i in range(len(whole) - n + 1))
        assert {r["term"]: r["tf"] for r in V.pooled_ngrams(df, "g", "i", "t", n).collect()} == dict(want)


def test_sweep_equals_each_cut(spark, sf):
    """Paragraphs of several bounds, cut once, are those of each cut alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("  \n")).alias("text"))
    bounds = {"base": (50, 500), "short": (30, 500), "split": (20, 100), "tiny": (1, 100)}
    swept = G.sweep_corpus(docs, bounds).select("doc_id", F.explode("bounds").alias("of"), "paragraph_text", "word_count")
    for name, (low, high) in bounds.items():
        want = G.build_corpus(docs, "text", low, high).select("doc_id", "paragraph_text", "word_count")
        got = swept.where(F.col("of") == name).drop("of")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name


def test_line_scanner_is_narrow(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f\n\nCHAPTER ONE IS A LONG HEADER\ng h i\n12\nj k l"), (1, "x y z"), (None, None), (2, "")], "id long, text string")
    out = G.labelled_paragraphs(df, "id", min_words=1)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.position, r.raw_text, r.is_header) for r in out.collect()]
    assert got == [(1, 0, "a b c d e f", False), (1, 2, "CHAPTER ONE IS A LONG HEADER", True), (1, 3, "g h i j k l", False), (1, 0, "x y z", False)]


def test_header_sections_part_at_headers_alone(spark):
    texts = {1: "from 71.206.91.2 on\n1.2. Summary", 2: "only 71.206.91.2 here", 3: "one 1.2 two", 4: "see 1.1.2. below", 5: "end.1.2. Main"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string").select("id", F.inline(G.header_sections(F.col("text"))))
    got = {}
    for r in df.collect():
        got.setdefault(r["id"], []).append(r["section_text"])
    assert got == {1: ["from 71.206.91.2 on", "1.2. Summary"], 2: [texts[2]], 3: ["one", "1.2 two"], 4: [texts[4]], 5: ["end.", "1.2. Main"]}


def test_enlargement_sections_search_each_header_once(spark):
    long = "b " * 10 + "1.3 not yet " + "c " * 30
    texts = {
        1: f"x 1.1. Context one 1.2. Summary {long}Cluster 1 end 1.2. SUMMARY", 2: "1.1 context alone 2\n2. next", 3: "no header", 4: None,
        5: "1.1 CONTEXT a page 3 of 4 b en-lar 2021 reportabc 2022 Report c 1.2 d", 6: "y 1.1 CONTEXT 1.1 CONTEXT 1.2",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, text string").select("id", G.enlargement_sections(F.col("text")).alias("s"))
    got = {r["id"]: r["s"] for r in df.collect()}
    assert got == {
        1: f"1.1. Context one\n\n* * *\n\n1.2. Summary {long}".strip(), 2: "1.1 context alone 2", 3: None, 4: None,
        5: "1.1 CONTEXT a  b  c\n\n* * *\n\n1.2 d", 6: "1.1 CONTEXT 1.1 CONTEXT\n\n* * *\n\n1.2",
    }
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FINDINGS") == 1 and plan.count("CONTEXT") == 1


def test_boilerplate_is_linear_in_long_words(spark):
    out = spark.range(1).select(X.strip_boilerplate(F.concat(F.repeat(F.lit("a"), 1_000_000), F.lit(" 2020 reportb 2021 report z"))).alias("t")).first()["t"]
    assert out == "z"


def test_stem_chunks_stem_once(spark):
    from tonemill.plans.models import stem_chunks

    docs = spark.createDataFrame([(1, ["Reports reported reporting.", "Courts judged."]), (2, ["short one."]), (3, None), (4, [])], "doc_id int, sentences array<string>")
    out = stem_chunks(docs, 2, 2)
    assert {(r["doc_id"], r["chunk"], *r["stems"]) for r in out.collect()} == {(1, 0, "report", "report", "report", "court", "judg")}
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    lists = spark.createDataFrame([(1, ["running", "runs"]), (2, None), (3, []), (4, ["runs"])], "id int, t array<string>").coalesce(1)
    got = {r["id"]: r["s"] for r in lists.select("id", stem.stem_lists(F.col("t"), stem.porter).alias("s")).collect()}
    assert got == {1: ["run", "run"], 2: None, 3: [], 4: ["run"]}
