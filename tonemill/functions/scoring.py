"""Column functions that score text against lexicons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill.functions.automaton import list_counts
from tonemill.functions.text import contains_any, word_count


def term_count(lower: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term, from left to right."""
    return ((F.length(lower) - F.length(F.replace(lower, term, F.lit("")))) / F.length(term)).cast("long")


def raw_count(text: Column, terms) -> Column:
    """Occurrences of all terms as substrings of the lower-cased text; nested terms count each.

    The text is lower-cased once, as the one element of an array, and only terms that it contains are counted.
    """
    found = lambda lower, n, t: n + F.when(F.contains(lower, t), term_count(lower, t)).otherwise(F.lit(0).cast("long"))
    total = F.transform(F.array(F.lower(text)), lambda lower: F.aggregate(F.array(*map(F.lit, terms)), F.lit(0).cast("long"), lambda n, t: found(lower, n, t)))
    return F.when(text.isNotNull(), F.get(total, F.lit(0)))


def raw_counts(text: Column, lists: dict) -> Column:
    """A struct of raw_count() for each list, in one walk over the text: for many or long lists."""
    return list_counts(F.lower(text), lists)


def per_thousand(count: Column, n_words: Column) -> Column:
    """Per 1,000 words; 0 without words."""
    return F.when(n_words > 0, count / n_words * 1000).otherwise(F.lit(0.0))


def dict_score(text: Column, terms) -> Column:
    return per_thousand(raw_count(text, terms), word_count(text))


def severity(hard: Column, soft: Column) -> Column:
    """hard / soft; null where soft is 0."""
    return F.when(soft > 0, hard / soft)


def topic_flags(text: Column, topics: dict) -> dict[str, Column]:
    """topic_<name>: whether any of the topic's terms is contained in the lower-cased text."""
    return {f"topic_{name}": contains_any(F.lower(text), terms) for name, terms in topics.items()}


def topic_flags_at_once(text: Column, topics: dict) -> Column:
    """A struct of topic_flags(), in one walk over the text: for many or long lists."""
    counts = F.transform(F.array(raw_counts(text, topics)), lambda n: F.struct(*((n[name] > 0).alias(f"topic_{name}") for name in topics)))
    return F.get(counts, F.lit(0))


def token_count(tokens: Column, lexicon) -> Column:
    """Tokens that are in the lexicon."""
    known = F.array(*map(F.lit, lexicon))
    return F.size(F.filter(tokens, lambda t: F.array_contains(known, t))).cast("long")


def progress(text: Column, scale: dict[str, int]) -> dict[str, Column]:
    """Counts of each phrase (nested phrases count each), all mentions, weighted sum, and their ratio (0 without mentions)."""
    counts = {phrase: raw_count(text, (phrase,)) for phrase in scale}
    mentions = reduce(lambda a, b: a + b, counts.values())
    weighted = reduce(lambda a, b: a + b, (n * F.lit(scale[p]) for p, n in counts.items()))
    ratio = F.when(mentions > 0, F.round(weighted / mentions, 3)).otherwise(F.lit(0.0))
    return {**counts, "progress_mentions": mentions, "progress_score_raw": weighted, "progress_score_norm": ratio}


def net_criticism(text: Column, hard, soft, reform_hard, reform_soft) -> Column:
    """Criticism less reform, each hard and soft, per 1,000 words."""
    return dict_score(text, hard) + dict_score(text, soft) - dict_score(text, reform_hard) - dict_score(text, reform_soft)


def vocabulary(tokens: Column, sample: int = 200) -> Column:
    """tokens, types, ttr, sttr_<sample>, hapax, hapax_pct of a list of tokens; all null for an empty one."""
    n, types = F.size(tokens), F.size(F.array_distinct(tokens))
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(a: Column, w: Column) -> Column:
        same = a["word"].eqNullSafe(w)
        return F.struct(w.alias("word"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["once"] + F.when(~same & (a["run"] == 1), 1).otherwise(0)).alias("once"))

    once = F.aggregate(F.array_sort(tokens), start, step, lambda a: a["once"] + F.when(a["run"] == 1, 1).otherwise(0))
    head = F.slice(tokens, 1, sample)
    some = n > 0
    return F.struct(
        F.when(some, n).alias("tokens"), F.when(some, types).alias("types"), F.when(some, F.round(types / n, 4)).alias("ttr"),
        F.when(some, F.round(F.size(F.array_distinct(head)) / F.size(head), 4)).alias(f"sttr_{sample}"),
        F.when(some, once).alias("hapax"), F.when(some, F.round(once / types * 100, 1)).alias("hapax_pct"),
    )
