"""Learned boundaries against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tonemill.models import sentences as S
from tonemill.plans import catalog



def sample():
    rng = random.Random(7)
    words = "court judge law report met sat left came ended stated noon city house paper reform vote".split()
    inner = ["Mr. Brown", "Dr. Ali", "e.g. water", "the U.S. court", "on 5. May", "at No. nine"]

    def sentence():
        body = rng.choices(words, k=rng.randint(4, 9))
        if rng.random() < 0.6:
            body.insert(rng.randint(1, len(body) - 1), rng.choice(inner))
        first = "The" if rng.random() < 0.7 else rng.choice(words).capitalize()
        return " ".join([first, *body]) + rng.choice([".", ".", ".", "!", "?", '."'])

    return [" ".join(sentence() for _ in range(10)) for _ in range(80)]


MIXED = "Mr. Brown met Dr. Ali at noon. The court sat (see e.g. water). It came on 5. May. Reform ended! A U.S. court sat. The U.S. The end."
TEXT = [*sample(), MIXED, None, "", "..."]


def plain_tokens(text):
    out = []
    for w in (text or "").split():
        w = re.sub(r"""[)"'”’»\]},;:!?]+$""", "", re.sub(r"""^[("'“‘«\[{]+""", "", w))
        kind = re.sub(r"\.+$", "", w).lower()
        if re.search(r"[^\W_]|#", kind):
            out.append((S.NUMBER if re.fullmatch(r"-?[.,]?\d[\d,.-]*", kind) else kind, bool(re.search(r"(?<!\.)\.$", w)), w[:1].isupper()))
    return out


def log_ratio(hits, others, p, q):
    term = lambda n, a: n * math.log(a) if n else 0.0
    return term(hits, p) + term(others, 1 - p) - term(hits, q) - term(others, 1 - q)


def together(a, b, ab, n):
    bound = lambda x: min(max(x, 1e-12), 1 - 1e-12)
    p, p1, p2 = bound(b / n), bound(ab / a), bound((b - ab) / (n - a))
    return -2 * (log_ratio(ab, a - ab, p, p1) + log_ratio(b - ab, n - a - b + ab, p, p2))


def plain_learn(texts):
    lists = [plain_tokens(t) for t in texts]
    counts = Counter((k, p) for row in lists for k, p, _ in row)
    n, periods = sum(counts.values()), sum(c for (_, p), c in counts.items() if p)
    abbreviations = set()
    for kind in {k for k, p in counts if p} - {S.NUMBER}:
        w, o = counts[kind, True], counts[kind, False]
        letters = len(kind) - kind.count(".")
        score = -2 * log_ratio(w, o, periods / n, 0.99) * math.exp(-letters) * (kind.count(".") + 1) * letters**-o
        if score >= S.ABBREVIATION:
            abbreviations.add(kind)
    kinds, starts, pairs, breaks = Counter(), Counter(), Counter(), 0
    for (k, _), c in counts.items():
        kinds[k] += c
    for row in lists:
        for (a, period, _), (b, _, _) in zip(row, row[1:], strict=False):
            if period and a not in abbreviations:
                if a == S.NUMBER or re.fullmatch(r"[^\W\d_]", a):
                    pairs[a, b] += 1
                else:
                    starts[b] += 1
                    breaks += 1
    starters = {b for b, ab in starts.items() if b.isalpha() and ab * n > kinds[b] * breaks and together(breaks, kinds[b], ab, n) >= S.STARTER}
    collocations = {f"{a} {b}" for (a, b), ab in pairs.items() if kinds[a] > 1 and kinds[b] > 1 and ab * n > kinds[a] * kinds[b] and together(kinds[a], kinds[b], ab, n) >= S.COLLOCATION}
    return abbreviations, starters, collocations


def test_learned_lists_equal_plain_python(spark, sf):
    for texts in (TEXT, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").collect()]):
        got = S.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
        want = plain_learn(texts)
        assert (set(got.abbreviations), set(got.starters), set(got.collocations)) == want
        assert got.abbreviations == sorted(got.abbreviations)


def test_splits(spark):
    df = spark.createDataFrame([(t,) for t in TEXT], "text string")
    learned = S.learn(df)
    assert {"mr", "dr", "u.s", "e.g"} <= set(learned.abbreviations) and not {"noon", "came", "court"} & set(learned.abbreviations)
    assert "the" in learned.starters and f"{S.NUMBER} may" in learned.collocations
    rows = {r.text: r.s for r in df.select("text", S.sentences(F.col("text"), learned).alias("s")).collect()}
    assert rows[MIXED] == ["Mr. Brown met Dr. Ali at noon.", "The court sat (see e.g. water).", "It came on 5. May.", "Reform ended!", "A U.S. court sat.", "The U.S.", "The end."]
    assert rows[None] is None and rows[""] == [] and rows["..."] == ["..."]
    assert S.learn(df.limit(0)) == S.Boundaries([], [], [])


def test_chunks_of_trained_sentences(spark, sf):
    chunks = catalog.queries()["trained_sentence_chunks"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {}
    for r in sorted(chunks, key=lambda r: (r.doc_id, r.chunk)):
        whole.setdefault(r.doc_id, []).append(r.text)
    assert all("".join(" ".join(v).split()) == "".join(texts[i].split()) for i, v in whole.items()) and len(whole) > 150


def test_counts_of_distinct_words_are_those_of_all_tokens(spark):
    rows = [("He met Dr. Fox (of p. 12), etc. Then \"Mr. Fox\" left... - 3.5 e.g. x",), ("",), (None,), ("Dr. Fox. dr. FOX.",)]
    docs = spark.createDataFrame(rows, "text string")
    each = docs.select(F.inline(S.tokens(F.col("text")))).groupBy("kind", "period").count().collect()
    assert {tuple(r) for r in S.token_counts(docs).collect()} == {tuple(r) for r in each} != set()


def test_few_words_are_taken_for_tokens(spark, monkeypatch):
    """Learning takes no whole text's words for tokens, and a part's first and last word are taken for tokens once."""
    df = spark.createDataFrame([(t,) for t in TEXT], "text string")
    learned = S.learn(df)
    assert str(S.sentences(F.col("text"), learned)).count("regexp_extract(") == 2
    monkeypatch.setattr(S, "tokens", None)
    assert S.learn(df) == learned and learned.collocations


def test_pairs_at_ends(spark):
    texts = ["A ... b. (C. 3.5 U.S. ?! \"Dr.\" x", "one.", "", None, "e.g. Next", "no stop at all", "«1.» —. z"]
    got = {r.text: [tuple(t["kind"] for t in p) for p in r.p or []] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", S._ends(F.col("text"), ["e.g"]).alias("p")).collect()}
    for text in texts:
        t = plain_tokens(text)
        assert got[text] == [(a[0], b[0]) for a, b in zip(t, t[1:], strict=False) if a[1] and a[0] != "e.g"]
