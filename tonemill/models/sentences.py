"""Sentence boundaries learned without labels: abbreviations, collocations and sentence starters by log-likelihood ratios.

After Kiss and Strunk (2006): a token that nearly always has a period, is short and has inner periods is an abbreviation; a number
or an initial and the word after its period that come together more often than by chance are a collocation; a word that follows
sentence ends more often than by chance is a starter. Counts of tokens and of pairs of neighbours are taken over all texts, in
Spark; only the learned lists, which the thresholds keep short, reach the driver and the split. The orthographic part of the
published procedure, which needs a table of all words, is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions import text as X
from tonemill.session import cut

# The published thresholds.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
NUMBER = "##number##"
#: The longest list that a split may be given.
MOST = 50_000


def tokens(text: Column) -> Column:
    """A list of (kind, period): words in lower case without quotes and brackets around them and without a last period, numbers as one
    kind; whether the word ends in a single period. Words of punctuation alone are left out."""
    return _kinds(X.words(text))


def _kinds(words: Column) -> Column:
    """tokens() of a list of words."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"""^[("'“‘«\[{]+""", ""), r"""[)"'”’»\]},;:!?]+$""", ""))

    def one(w: Column) -> Column:
        period = w.rlike(r"(?<!\.)\.$")
        kind = F.lower(F.regexp_replace(w, r"\.+$", ""))
        return F.struct(F.when(kind.rlike(r"^-?[.,]?\d[\d,.-]*$"), NUMBER).otherwise(kind).alias("kind"), period.alias("period"), w.rlike(r"^\p{Lu}").alias("upper"))

    return F.filter(F.transform(bare, one), lambda t: t["kind"].rlike(r"[\p{L}\d#]"))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, period, n of all texts' tokens: words are counted as they stand, and distinct ones alone are taken for tokens."""
    words = docs.select(F.explode(X.words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.inline(_kinds(F.array("w"))), "n").groupBy("kind", "period").agg(F.sum("n").alias("n"))


def _ratio(hits: Column, others: Column, p: Column, q: Column) -> Column:
    """The logarithm of the likelihood of so many hits and others under p, less that under q; a count of 0 counts nothing."""
    term = lambda n, a: F.when(n == 0, 0.0).otherwise(n * F.log(a))
    return term(hits, p) + term(others, 1 - p) - term(hits, q) - term(others, 1 - q)


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """kind, with_period, without_period, score of kinds that were seen with a period; counts: kind, period, n."""
    total = counts.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("period"), F.col("n"))).alias("periods"))
    by = counts.where(F.col("kind") != NUMBER).groupBy("kind").agg(F.coalesce(F.sum(F.when(F.col("period"), F.col("n"))), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(~F.col("period"), F.col("n"))), F.lit(0)).alias("o"))
    by = by.where("w > 0").crossJoin(F.broadcast(total))  # a row
    dots = F.length("kind") - F.length(F.replace("kind", F.lit("."), F.lit("")))
    letters = F.length("kind") - dots
    ratio = -2 * _ratio(F.col("w"), F.col("o"), F.col("periods") / F.col("all"), F.lit(0.99))
    score = ratio * F.exp(-letters.cast("double")) * (dots + 1) * F.pow(letters.cast("double"), -F.col("o").cast("double"))
    return by.select("kind", F.col("w").alias("with_period"), F.col("o").alias("without_period"), score.alias("score"))


def _together(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """The log-likelihood ratio of a pair's count, given those of its two sides, in n tokens."""
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))
    p, p1, p2 = bounded(p), bounded(p1), bounded(p2)
    return -2 * (_ratio(ab, a - ab, p, p1) + _ratio(b - ab, n - a - b + ab, p, p2))


@dataclass
class Boundaries:
    """What was learned: kinds of abbreviations and of starters; collocations as `kind next`."""

    abbreviations: list[str]
    starters: list[str]
    collocations: list[str]


def _short(df: DataFrame, what: str) -> list[str]:
    found = [r[0] for r in df.orderBy(df.columns[0]).limit(MOST + 1).collect()]
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} {what} were learned")
    return found


def _ends(text: Column, abbreviations: list[str]) -> Column:
    """Each token with a period that is no abbreviation, and the token after it. Only words with a stop, and those after them, are taken for
    tokens; a word without letter, digit and # is none."""
    words = F.filter(X.words(text), lambda w: w.rlike(r"[\p{L}\d#]"))

    def pairs(t: Column) -> Column:
        at = F.when(F.size(t) > 1, F.sequence(F.lit(0), F.size(t) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, lambda i: F.contains(F.get(t, i), F.lit("."))), lambda i: _kinds(F.slice(t, i + 1, 2)))

    # words are worked out once, as the one element of an array
    return F.filter(F.flatten(F.transform(F.array(words), pairs)), lambda k: F.get(k, F.lit(0))["period"] & ~F.get(k, F.lit(0))["kind"].isin(abbreviations))


def learn(docs: DataFrame, text: str = "text") -> Boundaries:
    """Learns from all texts. Nulls and empty texts hold no tokens; without tokens nothing is learned."""
    counts = cut(token_counts(docs, text))
    abbreviations = _short(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION).select("kind"), "abbreviations")
    pairs = docs.select(F.explode(_ends(F.col(text), abbreviations)).alias("p")).select(F.struct(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b")).alias("p"))
    loose = F.col("p.a.kind").rlike(r"^\p{L}$") | (F.col("p.a.kind") == NUMBER)
    ends = cut(pairs.groupBy(F.col("p.a.kind").alias("a"), F.col("p.b.kind").alias("b"), loose.alias("loose")).agg(F.count(F.lit(1)).alias("ab")))
    kinds = counts.groupBy("kind").agg(F.sum("n").alias("n"))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    breaks = ends.where("not loose").agg(F.coalesce(F.sum("ab"), F.lit(0))).first()[0]
    n, all_breaks = F.lit(size), F.lit(breaks)

    after = ends.where("not loose").groupBy("b").agg(F.sum("ab").alias("ab")).join(kinds.withColumnRenamed("kind", "b"), "b")
    starts = after.where(F.col("b").rlike(r"^\p{L}+$") & (F.col("ab") * n > F.col("n") * all_breaks))
    starters = _short(starts.where(_together(all_breaks, F.col("n"), F.col("ab"), n) >= STARTER).select("b"), "starters")
    both = ends.where("loose").join(kinds.select(F.col("kind").alias("a"), F.col("n").alias("na")), "a").join(kinds.select(F.col("kind").alias("b"), F.col("n").alias("nb")), "b")
    both = both.where((F.col("na") > 1) & (F.col("nb") > 1) & (F.col("ab") * n > F.col("na") * F.col("nb")))
    collocations = _short(both.where(_together(F.col("na"), F.col("nb"), F.col("ab"), n) >= COLLOCATION).select(F.concat_ws(" ", "a", "b")), "collocations")
    return Boundaries(abbreviations, starters, collocations)


def sentences(text: Column, learned: Boundaries) -> Column:
    """Sentences: texts parted after a stop and white space, and put together again after an abbreviation (unless a starter in upper case
    follows) and inside a collocation."""
    parts = F.filter(F.split(X.strip(text), r"""(?<=[.!?]|[.!?][)"'”’»])(?U)\s+"""), lambda s: s != "")

    def goes_on(a: Column, b: Column) -> Column:
        """Whether there is no boundary between the part that ends in token a and that which begins with token b."""
        abbreviated = a["kind"].isin(learned.abbreviations) & ~(b["upper"] & b["kind"].isin(learned.starters))
        return a["period"] & (abbreviated | F.concat_ws(" ", a["kind"], b["kind"]).isin(learned.collocations))

    def ends(s: Column) -> Column:
        """A part, its first and its last token; each is worked out once."""
        return F.struct(s.alias("s"), F.get(tokens(F.regexp_extract(s, r"^(\S+)", 1)), F.lit(0)).alias("first"), F.try_element_at(tokens(F.regexp_extract(s, r"(?<!\S)(\S+)$", 1)), F.lit(-1)).alias("last"))

    def glued(p: Column) -> Column:
        edges = F.transform(p, lambda e, i: F.struct(e["s"].alias("s"), F.when(i == 0, False).otherwise(F.coalesce(goes_on(F.get(p, i - 1)["last"], e["first"]), F.lit(False))).alias("on")))
        # a sentence never holds \u0000 here: parts that go on are joined by a blank, others parted by it
        whole = F.array_join(F.transform(edges, lambda e, i: F.concat(F.when(i == 0, "").when(e["on"], " ").otherwise("\0"), F.replace(e["s"], F.lit("\0"), F.lit("")))), "")
        return F.filter(F.split(whole, "\0"), lambda s: s != "")

    return F.get(F.transform(F.array(F.transform(parts, ends)), glued), F.lit(0))
