"""Operators that cut documents into pages, sections, paragraphs, sentences and n-grams.

All are narrow: higher-order functions over one row's text, then one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions import text as X

MIN_WORDS, MAX_WORDS = 50, 500
PAGE_MARK = r"(?U)={3,}\s*PAGE\s+\d+\s*={3,}"
STARS = r"(?U)\s*\*\s*\*\s*\*\s*"


def paragraph_list(text: Column, arrows: bool = True) -> Column:
    """Candidate paragraphs: page marks off, two blanks before a line end or a full sentence before a capital part them."""
    out = F.regexp_replace(text, PAGE_MARK, "")
    out = F.replace(out, F.lit("  \n"), F.lit("\n\n"))
    out = F.regexp_replace(out, r"([A-Za-z]{4,}[.!?]) \n(?=[A-Z" + "→" * arrows + "])", "$1\n\n")
    return F.transform(F.split(out, r"\n{2,}"), lambda c: X.strip(F.replace(c, F.lit("\n"), F.lit(" "))))


def paragraph_list_simple(text: Column, min_words: int = 20) -> Column:
    """The exploratory variant: the first signal alone, short paragraphs off."""
    parts = F.transform(F.split(F.replace(text, F.lit("  \n"), F.lit("\n\n")), r"\n{2,}"), lambda c: X.strip(F.replace(c, F.lit("\n"), F.lit(" "))))
    return F.filter(parts, lambda c: X.word_count(c) >= min_words)


def split_long(text: Column, max_words: int = MAX_WORDS) -> Column:
    """Runs of whole sentences, each closed once it has max_words or more; what remains is a last chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def add(a: Column, s: Column) -> Column:
        now, n = F.concat_ws(" ", a["now"], s), a["n"] + X.word_count(s)
        full = n >= max_words
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(now))).otherwise(a["done"]).alias("done"),
            F.when(~full, now).alias("now"), F.when(full, 0).otherwise(n).alias("n"),
        )

    end = lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))
    return F.aggregate(F.split(text, r"(?<=[.!?])(?U)\s+"), start, add, end)


def build_corpus(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_words: int = MAX_WORDS, arrows: bool = True) -> DataFrame:
    """docs' other columns with paragraph_id (0, 1, ... in each row), paragraph_text, word_count.

    Paragraphs under min_words go, before and after those over max_words are split. Null text gives no row.
    """
    counted = lambda p: F.struct(p.alias("text"), X.word_count(p).alias("n"))  # noqa: E731  words are counted once a paragraph
    enough = lambda s: s["n"] >= min_words
    kept = F.filter(F.transform(paragraph_list(F.col(text), arrows), counted), enough)
    parts = F.flatten(F.transform(kept, lambda s: F.when(s["n"] > max_words, F.filter(F.transform(split_long(s["text"], max_words), counted), enough)).otherwise(F.array(s))))
    others = [c for c in docs.columns if c != text]
    out = docs.select(*others, F.posexplode(parts).alias("paragraph_id", "part"))
    return out.select(*others, "paragraph_id", F.col("part.text").alias("paragraph_text"), F.col("part.n").alias("word_count"))


def sweep_corpus(docs: DataFrame, bounds: dict[str, tuple[int, int]], text: str = "text", arrows: bool = True) -> DataFrame:
    """docs' other columns with bounds (names), paragraph_text, word_count: the paragraphs of build_corpus() under several
    (min_words, max_words), cut once; a paragraph has the names of all bounds under which it is one."""
    counted = lambda p: F.struct(p.alias("text"), X.word_count(p).alias("n"))
    least = min(low for low, _ in bounds.values())
    kept = F.filter(F.transform(paragraph_list(F.col(text), arrows), counted), lambda s: s["n"] >= least)

    def under(high: int) -> Column:
        """Paragraphs under the bounds that end at `high`, with their names."""
        names = lambda s: F.array_compact(F.array(*(F.when(s["n"] >= low, name) for name, (low, top) in bounds.items() if top == high)))
        parts = F.flatten(F.transform(kept, lambda s: F.when(s["n"] > high, F.transform(split_long(s["text"], high), counted)).otherwise(F.array(s))))
        return F.filter(F.transform(parts, lambda s: F.struct(names(s).alias("bounds"), s["text"].alias("paragraph_text"), s["n"].alias("word_count"))), lambda s: F.size(s["bounds"]) > 0)

    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.inline(F.concat(*(under(high) for high in sorted({high for _, high in bounds.values()})))))


def parse_filename(name: Column) -> tuple[Column, Column]:
    """(country, year) of `<slug>_<year>_raw.txt`; nulls for other names."""
    slug, year = (F.regexp_extract(name, r"^(.+?)_(\d{4})_raw\.txt$", i) for i in (1, 2))
    return F.when(slug != "", X.title_label(slug)), F.when(year != "", year.cast("int"))


def parse_tokens(name: Column) -> tuple[Column, Column]:
    """(slug, year as text): the first token of four digits, and what stands before it; nulls without one."""
    parts = F.split(name, "_")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{4}$")), True).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0))), "_")), F.when(at > 0, F.get(parts, at - 1))


def parse_report_name(name: Column) -> tuple[Column, Column]:
    """(slug, year): parts between `-` and `_`; the slug ends before `report`, or else before the year."""
    parts = F.split(F.lower(F.regexp_replace(name, r"(?i)\.pdf$", "")), "[-_]")
    year_at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{4}$")), True).cast("int")
    report_at = F.array_position(parts, "report").cast("int")
    end = F.when(report_at > 0, report_at).otherwise(year_at)
    return F.when(end > 0, F.array_join(F.slice(parts, 1, F.greatest(end - 1, F.lit(0))), "_")), F.when(year_at > 0, F.get(parts, year_at - 1))


def parse_loose(name: Column) -> tuple[Column, Column]:
    """(first part, the part of four digits or `Unknown`)."""
    parts = F.split(F.regexp_replace(name, r"(?i)\.pdf$", ""), "[-_]")
    return F.get(parts, F.lit(0)), F.coalesce(F.get(F.filter(parts, lambda p: p.rlike(r"^\d{4}$")), F.lit(0)), F.lit("Unknown"))


def page_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns with page, page_text, word_count: what follows each page mark; text before the first and empty pages go."""
    numbers = F.regexp_extract_all(F.col(text), F.lit(r"(?U)={3,}\s*PAGE\s+(\d+)\s*={3,}"), F.lit(1))
    bodies = F.transform(F.split(F.col(text), PAGE_MARK), X.strip)
    pages = F.zip_with(numbers, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda n, b: F.struct(n.cast("int").alias("page"), b.alias("page_text")))
    others = [c for c in docs.columns if c != text]
    out = docs.select(*others, F.inline(F.filter(pages, lambda p: p["page_text"] != "")))
    return out.withColumn("word_count", X.word_count(F.col("page_text")))


def page_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PAGE_MARK)).cast("int")


# Fixed value: what a header line looks like.
HEADER = r"^(?:(?U:\d+\.?\d*\.?\s+)[A-Z](?U:[A-Z\s\-])+|[Cc]hapter(?U:\s+\d+[:\s]).*|[A-Z](?U:[A-Z\s/\-]){14,}|\*(?U:\s*)\*(?U:\s*)\*)(?U:\s*)$"


def labelled_paragraphs(docs: DataFrame, key: str, text: str = "text", min_words: int = 8) -> DataFrame:
    """key, position, raw_text, paragraph, is_header, n_words: lines gathered to paragraphs.

    A blank line ends a paragraph; a header line ends it and stands alone; a lone number of up to three digits is skipped
    without ending it. Paragraphs under min_words go. A row's lines are folded in the row: an edge (a header, a blank line or the
    line after a header) begins a new piece, whose place is the position; no line is shuffled, and rows of one key stay apart.
    """
    plain = F.replace(F.regexp_replace(F.col(text), r"(?md)^={3,}.*?={3,}$", "\n"), F.lit("→"), F.lit(" "))
    lines = F.transform(F.split(plain, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), X.strip)
    lines = F.filter(lines, lambda t: ~t.rlike(r"^(?U:\d{1,3})$"))
    flagged = F.transform(lines, lambda t: F.struct(t.alias("t"), t.rlike(HEADER).alias("head")))
    # lines hold none of \n, \r and \v, so these can mark the ends of lines, edges and headers

    def marked(f: Column) -> Column:
        after = lambda i: F.coalesce(F.get(f, i - 1)["head"], F.lit(False))
        edge = lambda s, i: F.when(s["head"], "\r\v").when((s["t"] == "") | after(i), "\r").otherwise("")
        return F.array_join(F.transform(f, lambda s, i: F.concat(edge(s, i), s["t"])), "\n")

    # flagged lines are worked out once, as the one element of an array
    joined = F.get(F.transform(F.array(flagged), marked), F.lit(0))
    out = docs.select(key, F.posexplode(F.split(joined, "\r")).alias("position", "piece"))
    own = F.filter(F.split(F.replace("piece", F.lit("\v"), F.lit("")), "\n"), lambda t: t != "")
    out = out.select(key, F.col("position").cast("long").alias("position"), F.array_join(own, " ").alias("raw_text"), F.startswith("piece", F.lit("\v")).alias("is_header")).where("raw_text <> ''")
    out = out.withColumn("paragraph", X.squeeze(F.lower("raw_text")))
    return out.withColumn("n_words", X.word_count(F.col("paragraph"))).where(F.col("n_words") >= min_words)


def star_sections(text: Column) -> Column:
    """(section, section_text): two sections parted by three stars, or the whole as one."""
    parts = F.split(text, STARS)
    two = F.array(F.struct(F.lit("1.1_Context").alias("section"), X.strip(F.get(parts, F.lit(0))).alias("section_text")), F.struct(F.lit("1.2_Summary").alias("section"), X.strip(F.get(parts, F.lit(1))).alias("section_text")))
    one = F.array(F.struct(F.lit("Full_Summary").alias("section"), X.strip(text).alias("section_text")))
    return F.when(F.size(parts) >= 2, two).otherwise(one)


def header_sections(text: Column) -> Column:
    """As star_sections(), but without stars the header `1.2` parts the sections; a single part is 1.1_Context. The end of a longer
    number, as of an address, is no header."""
    plain = F.replace(text, F.lit("∗"), F.lit("*"))
    stars = F.split(plain, STARS)
    parts = F.when(F.size(stars) >= 2, stars).otherwise(F.split(plain, r"(?<![0-9])(?<![0-9]\.)(?=1\.2\.?(?U:\s))"))
    section = lambda name, t: F.struct(F.lit(name).alias("section"), X.strip(t).alias("section_text"))
    two = F.array(section("1.1_Context", F.get(parts, F.lit(0))), section("1.2_Summary", F.get(parts, F.lit(1))))
    return F.when(F.size(parts) >= 2, two).otherwise(F.array(section("1.1_Context", plain)))


def explode_sections(docs: DataFrame, sections: Column, text: str = "text") -> DataFrame:
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.inline(sections)).withColumn("word_count", X.word_count(F.col("section_text")))


# How reports number and name their sections.
CONTEXT = r"(?iu)1\.1\.?\s*\n?\s*CONTEXT"
SUMMARY = r"(?iu)1\.2\.?\s{0,4}\n?\s{0,4}(SUMMARY|MAIN\s+FINDINGS?|)"
AFTER = r"(?ium)(1\.3[\.\s]|CLUSTER\s+1|THE\s+FUNDAMENTALS\s+OF\s+THE\s+ACCESSION|^2\.\s)"


def enlargement_sections(text: Column) -> Column:
    """The text from 1.1 to 1.2 and from 1.2 to its end, boilerplate off, parted by stars; 1.1 alone without 1.2; null without 1.1."""
    plain = F.replace(F.replace(text, F.lit("∗"), F.lit("*")), F.lit("* * *"), F.lit("***"))

    def once(x: Column, f) -> Column:
        """f(x), where x is worked out once, as the one element of an array."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def ended(t: Column, start: Column) -> Column:
        """t without what follows the first end at or after the place start."""
        return once(F.regexp_instr(F.substr(t, start), F.lit(AFTER)), lambda end: F.when(end > 0, F.substr(t, F.lit(1), start + end - 2)).otherwise(t))

    def parted(head: Column, rest: Column, next_head: Column, at2: Column) -> Column:
        first = F.concat(head, F.when(at2 > 0, F.substr(rest, F.lit(1), at2 - 1)).otherwise(ended(rest, F.lit(1))))
        second = ended(F.substr(rest, at2), F.length(next_head) + 51)
        both = X.strip(F.concat(X.strip_boilerplate(first), F.lit("\n\n* * *\n\n"), X.strip_boilerplate(second)))
        return F.when(at2 > 0, both).otherwise(X.strip_boilerplate(first))

    def after(head: Column, rest: Column) -> Column:
        """rest: what follows the first header."""
        return once(F.regexp_extract(rest, SUMMARY, 0), lambda n: once(F.when(n != "", F.instr(rest, n)).otherwise(0), lambda at2: parted(head, rest, n, at2)))

    found = lambda t, head: F.when(head != "", once(F.substr(t, F.instr(t, head) + F.length(head)), lambda rest: after(head, rest)))
    return once(plain, lambda t: once(F.regexp_extract(t, CONTEXT, 0), lambda head: found(t, head)))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first match of start and the first of end, stripped; empty if either is missing or they cross."""
    a, n, b = F.regexp_instr(text, F.lit(start)), F.length(F.regexp_extract(text, start, 0)), F.regexp_instr(text, F.lit(end))
    return F.when((a > 0) & (b > 0), X.strip(F.substr(text, a + n, F.greatest(b - a - n, F.lit(0))))).otherwise("")


FINDINGS = (r"1\.2\.?\s+(?:Main findings of the report|Summary of the report)", r"2\.\s+[Tt]he [Ff]undamentals of the [Aa]ccession [Pp]rocess")


def main_findings(text: Column) -> Column:
    return between(text, *FINDINGS)


def robust_slice(text: Column, start: str = r"1\.1 CONTEXT", end: str = r"2 CLUSTER 1", head: int = 10_000) -> Column:
    """The text from start to before end, of single-spaced text; else its first characters."""
    plain = X.squeeze(text)
    a, b = F.regexp_instr(plain, F.lit(f"(?iu){start}")), F.regexp_instr(plain, F.lit(f"(?iu){end}"))
    return F.when((a > 0) & (b > a), X.strip(F.substr(plain, a, b - a))).otherwise(F.substring(plain, 1, head))


def sentences(text: Column, min_chars: int = 25) -> Column:
    """Sentences parted at a stop before a capital, put together again after abbreviations; short ones off; stops added."""
    parts = F.filter(F.transform(F.split(X.fix_encoding(text), r"\.(?U:\s+)(?=[A-Z])"), X.strip), lambda s: s != "")

    def starts(p: Column) -> Column:
        """Where a sentence begins: at every part but those after an abbreviation."""
        at = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (i == 0) | ~X.ends_in_abbreviation(F.get(p, i - 1)))

    def joined(p: Column, at: Column) -> Column:
        return F.transform(at, lambda i, j: F.array_join(F.slice(p, i + 1, F.coalesce(F.get(at, j + 1), F.size(p)) - i), ". "))

    # parts and starts are each worked out once, as the one element of an array
    glued = F.flatten(F.transform(F.array(parts), lambda p: F.flatten(F.transform(F.array(starts(p)), lambda at: joined(p, at)))))
    return F.transform(F.filter(glued, lambda s: F.length(s) >= min_chars), lambda s: F.concat(s, F.lit(".")))


def labelled_sentences(docs: DataFrame, key: str, text: str = "text", anchors=None, actions=None, intentions=None) -> DataFrame:
    """docs' other columns with position, topic, label, sentence; the topic is that of the last sentence with an anchor."""
    others = [c for c in docs.columns if c != text]
    out = docs.select(*others, F.posexplode(sentences(F.col(text))).alias("position", "sentence"))
    order = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    topic = F.coalesce(F.last(X.anchor_topic(F.col("sentence"), anchors), ignorenulls=True).over(order), F.lit("General"))
    lists = [x for x in (actions, intentions) if x]
    return out.withColumns({"topic": topic, "label": X.classify_sentence(F.col("sentence"), *lists)})


def fixed_chunks(sents: Column, size: int = 5) -> Column:
    """Consecutive sentences, `size` at a time, joined by blanks."""
    starts = F.when(F.size(sents) > 0, F.sequence(F.lit(0), F.size(sents) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(sents, i + 1, size), " "))


def line_headers(docs: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """key, line_no, num, title: lines that match a header pattern with two groups."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    return lines.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("num"), X.strip(F.regexp_extract("line", pattern, 2)).alias("title"))


def model_tokens(text: Column, stops=()) -> Column:
    """Lower-case tokens of three letters or more that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda t: ~t.isin(*stops) if stops else F.lit(True))


def alphabetic_tokens(text: Column, least: int = 4, stops=()) -> Column:
    """Lower-case tokens between white space, without punctuation around them, that are letters only and no stop words."""
    bare = F.transform(X.words(F.lower(text)), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.filter(bare, lambda w: w.rlike(r"^\p{L}+$") & (F.length(w) >= least) & (~w.isin(*stops) if stops else F.lit(True)))


def vector_tokens(text: Column, stops=()) -> Column:
    """Lower-case tokens of two word characters or more, stop words off."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1)), lambda t: ~t.isin(*stops) if stops else F.lit(True))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of low to high tokens, joined by blanks."""
    def runs_of(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(tokens, i + k) for k in range(n))))  # slice() would copy the whole list each time

    runs = [runs_of(n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def page_window(pages: DataFrame, key: str, start: str, end: str, page: str = "page", text: str = "page_text", first: int = 2, last: int = 11, span: int = 20) -> DataFrame:
    """key, page, text: the pages of each document from the first of the early ones that matches start, to before the next that
    matches end, or else `span` pages. Documents without a start are left out."""
    w = Window.partitionBy(key)
    begin = F.min(F.when(F.col(text).rlike(start) & F.col(page).between(first, last), F.col(page))).over(w)
    found = pages.withColumn("_begin", begin).where("_begin is not null")
    stop = F.min(F.when((F.col(page) > F.col("_begin")) & F.col(text).rlike(end), F.col(page))).over(w)
    found = found.withColumn("_stop", F.coalesce(stop, F.col("_begin") + span))
    return found.where((F.col(page) >= F.col("_begin")) & (F.col(page) < F.col("_stop"))).select(key, page, text)
