"""Column functions over text: words, trimming, cleaning rules, classification."""

from __future__ import annotations

import re
from functools import reduce
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill.lexicons import ABBREVIATIONS, ACTION_PHRASES, ANCHORS, INTENTION_PHRASES, MOJIBAKE

SPACE = r"(?U)\s+"


def words(text: Column) -> Column:
    """Words between Unicode white space; none for an empty text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fold(text: Column, rules, by: str = " ") -> Column:
    """Replaces the matches of each pattern in turn."""
    return reduce(lambda t, rule: F.regexp_replace(t, rule, by), rules, text)


def title_label(slug: Column) -> Column:
    """A slug's words with capitals: `north_macedonia` as `North Macedonia`."""
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def slugify(name: Column) -> Column:
    """Compatibility forms and accents undone, letters outside ASCII and punctuation dropped, lower case, blanks as one hyphen."""

    @F.pandas_udf("string")
    def to_ascii(names: pd.Series) -> pd.Series:
        return names.map(lambda t: normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    plain = F.regexp_replace(F.lower(to_ascii(name)), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[^\w\s-]", ""), r"\s+", "-"), "-+", "-")


# Structural noise, matched in the original case, then boilerplate, matched in lower case. `d`: only \n ends a line.
STRUCTURAL = (
    r"(?md)^={3,}[^\n]*={3,}$",
    r"(?mdU)^[^\n]+\.{4,}\s*\d+\s*$",
    r"(?mdU)\*\s*\*\s*\*",
    r"(?mdU)^\s*\d{1,3}\s*$",
    r"(?md)^(?U:\s*\d+\.?\d*\.?\s+)[A-Z](?U:[A-Z\s\-])+(?U:\s*)$",
    r"(?md)^[Cc]hapter(?U:\s+\d+[:\s])[^\n]*$",
    r"(?md)^[A-Z](?U:[A-Z\s/\-]){14,}$",
    "→",
)
BOILERPLATE = (
    r"(?mds)the report uses the following assessment scale.*?interim steps have also been used\.?",
    r"(?mds)this report covers the period from.*?in particular in the area of rule of law\.?",
    r"(?md)the commission.s recommendations from last year[^\n]*\.",
    r"(?mdU)in the coming year,\s+\w[\w\s,]+(?:should|needs|need to)[^\n]*",
    r"(?U)(?<=\w)\d{1,2}(?=[\s,.])",
)


def drop_structure(text: Column) -> Column:
    return fold(text, STRUCTURAL)


def clean_text(text: Column) -> Column:
    """Both phases of cleaning; lower case, single spaces."""
    return squeeze(fold(F.lower(drop_structure(text)), BOILERPLATE))


def cleaning_report(text: Column) -> Column:
    """Word counts before, between and after the phases, and the share removed in per cent."""
    raw, middle, final = word_count(text), word_count(drop_structure(text)), word_count(clean_text(text))
    share = F.when(raw > 0, F.round(100 * (raw - final) / raw, 1)).otherwise(F.lit(0.0))
    return F.struct(
        raw.alias("raw_words"), middle.alias("after_structural"), final.alias("final_words"),
        (raw - middle).alias("structural_removed"), (middle - final).alias("boilerplate_removed"),
        (raw - final).alias("total_removed"), share.alias("pct_removed"),
    )


# Section headers that every report repeats.
HEADINGS = (
    r"(?iu)1\s*\.\s*INTRODUCTION[12]?\s*",
    r"(?iu)1\s*\.1[\.]?\s*CONTEXT\s*",
    r"(?iu)1\s*\.2[\.]?\s*(MAIN\s+FINDINGS\s+OF\s+THE\s+REPORT|SUMMARY\s+OF\s+THE\s+REPORT)\s*",
    r"(?iu)CLUSTER\s+\d+\s*[:–\-]\s*",
)


def clean_section(text: Column) -> Column:
    """The section cleaner: lone page numbers, footnote digits and headings off; single spaces; lower case."""
    out = F.regexp_replace(text, r"(?mdU)^\s*\d{1,3}\s*$", "")
    out = F.regexp_replace(out, r"(?U)(?<=\w)\d{1,2}(?=\s)", "")
    return F.lower(squeeze(fold(out, HEADINGS, "")))


def normalise_pages(text: Column) -> Column:
    """Page markers as blanks, single spaces, lower case."""
    return F.lower(squeeze(F.regexp_replace(text, r"(?U)={3,}\s*PAGE\s+\d+\s*={3,}", " ")))


def fix_encoding(text: Column) -> Column:
    """Undoes common wrong decodings and soft hyphens; single spaces."""
    return squeeze(reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text))


def strip_boilerplate(text: Column) -> Column:
    """Without page footers and running headers. A header's first word is tried from its start alone, or from the end of the header before."""
    out = F.regexp_replace(text, r"(?iu)page(?U:\s*\d+)((?U:\s+)of(?U:\s+\d+))?", "")
    return strip(F.regexp_replace(out, r"(?iu)(?:(?<![a-z-])|\G)[a-z-]++(?U:\s+\d{4}\s+)report", ""))


def drop_punctuation(text: Column) -> Column:
    """Lower case, without anything but word characters and white space."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def contains_any(text: Column, phrases) -> Column:
    """Whether any phrase is contained; the text is worked out once, as the one element of an array."""
    found = F.transform(F.array(text), lambda t: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p)))
    return F.get(found, F.lit(0))


def classify_sentence(text: Column, actions=ACTION_PHRASES, intentions=INTENTION_PHRASES) -> Column:
    """Action_Status, else Intention_Requirement, else Description, by phrases contained in lower case."""
    lower = F.lower(text)
    return F.when(contains_any(lower, actions), "Action_Status").when(contains_any(lower, intentions), "Intention_Requirement").otherwise("Description")


def anchor_topic(text: Column, anchors=None) -> Column:
    """The last topic any of whose patterns is found, in any case; null if none is."""
    found = [F.when(reduce(lambda a, b: a | b, (text.rlike(f"(?iu){p}") for p in patterns)), topic) for topic, patterns in (anchors or ANCHORS).items()]
    return F.coalesce(*reversed(found))


def ends_in_abbreviation(text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:\A| )(?:{'|'.join(re.escape(a) for a in ABBREVIATIONS)})\z")


def drop_leading_number(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\d+\.?\s*", "")


def stars(p: Column) -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def level_name(label: Column) -> Column:
    """The level inside a design-matrix name such as `C(x, Treatment('a'))[T.b]`; other names unchanged."""
    level = F.regexp_extract(label, r"[TS]\.(.+?)\]", 1)
    return F.when(level != "", level).otherwise(label)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", 100 * x)


def percent_change(x: Column, base: Column) -> Column:
    """Change against a baseline as text, rounded to one place."""
    return F.when(base != 0, F.format_string("%.1f%%", F.round(100 * (x - base) / base, 1)))


def interval(low: Column, high: Column) -> Column:
    return F.format_string("[%.3f, %.3f]", low, high)
