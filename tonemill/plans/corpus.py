"""Queries: corpus building, segmentation, cleaning and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill import sql
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.operators import segment
from tonemill.plans.adapter import LINES, PARAS, REPORTS, paragraphs, reports, table, words_sql
from tonemill.plans.registry import ORACLES, query


@query(f"WITH {PARAS} SELECT * FROM paras")
def paragraph_table(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "country", "year", "paragraph_id", "paragraph_text", "word_count")


@query(rf"""WITH t AS (SELECT doc_id, replace(text, chr(10), ' ' || chr(10) || CASE WHEN doc_id % 2 = 1 THEN '→' ELSE '' END) AS text FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '  ' || chr(10), chr(10) || chr(10)), '([A-Za-z]{{4,}}[.!?]) \n([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g'), '([A-Za-z]{{4,}}[.!?]) \n([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g') AS text FROM t),
p AS (SELECT doc_id, unnest(range(len(c))) AS i, unnest(c) AS p FROM (SELECT doc_id, list_transform(string_split_regex(text, '
{{2,}}'), lambda x: trim(replace(x, chr(10), ' '))) AS c FROM m))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_id, p AS paragraph_text, {words_sql('p')} AS word_count FROM p WHERE {words_sql('p')} >= 20""")
def paragraph_table_without_arrows(spark, sf_dir):
    """The variant in which an arrow does not begin a paragraph; lines of odd documents begin with one. (The SQL, without lookahead,
    passes twice, for lines of a single word.)"""
    arrow = F.when(F.col("doc_id") % 2 == 1, "→").otherwise("")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select("doc_id", F.replace("text", F.lit("\n"), F.concat(F.lit(" \n"), arrow)).alias("text"))
    return segment.build_corpus(docs, "text", 20, 10**9, arrows=False)


_STEP = "struct_pack(done := CASE WHEN {full} THEN a.done || [{now}] ELSE a.done END, cur := CASE WHEN {full} THEN NULL ELSE {now} END, n := CASE WHEN {full} THEN 0 ELSE a.n + x.n END)"
_STEP = _STEP.format(full="a.n + x.n >= 100", now="CASE WHEN a.cur IS NULL THEN x.cur ELSE a.cur || ' ' || x.cur END")


@query(rf"""WITH {REPORTS}, {LINES},
kept AS (SELECT doc_id, i, p, wc FROM lines WHERE wc >= 50),
sents AS (SELECT doc_id, i, list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: struct_pack(done := CAST([] AS VARCHAR[]), cur := s, n := {words_sql('s')})) AS s FROM kept WHERE wc > 100),
folded AS (SELECT doc_id, i, list_reduce(s, lambda a, x: {_STEP}, struct_pack(done := CAST([] AS VARCHAR[]), cur := CAST(NULL AS VARCHAR), n := CAST(0 AS INTEGER))) AS f FROM sents),
chunks AS (SELECT doc_id, i, CASE WHEN f.cur IS NULL THEN f.done ELSE f.done || [f.cur] END AS c FROM folded
  UNION ALL SELECT doc_id, i, [p] FROM kept WHERE wc <= 100),
parts AS (SELECT doc_id, i, j, t, {words_sql('t')} AS word_count FROM (SELECT doc_id, i, unnest(range(len(c))) AS j, unnest(c) AS t FROM chunks))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS paragraph_id, t AS paragraph_text, word_count
FROM parts WHERE word_count >= 50""")
def paragraph_table_split(spark, sf_dir):
    """Long paragraphs are split at sentences, from 100 words on."""
    return paragraphs(spark, sf_dir, 50, 100).select("doc_id", "paragraph_id", "paragraph_text", "word_count")


@query(rf"""WITH {REPORTS}, {LINES} SELECT doc_id, CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(wc) AS BIGINT) AS n_words FROM lines WHERE wc >= 20 GROUP BY doc_id""")
def exploratory_chunks(spark, sf_dir):
    """The variant with the first paragraph signal alone."""
    out = reports(spark, sf_dir).select("doc_id", segment.paragraph_list_simple(F.col("text")).alias("c")).where(F.size("c") > 0)
    return out.select("doc_id", F.size("c").alias("n_chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda n, p: n + X.word_count(p)).alias("n_words"))


_NAME = "replace(source, 'src', 'north_src_') || '_' || (2019 + doc_id % 7) || CASE WHEN doc_id % 5 = 0 THEN '_corpus.txt' ELSE '_raw.txt' END"


def _names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.replace("source", F.lit("src"), F.lit("north_src_")), F.lit("_"), (2019 + F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 5 == 0, "_corpus.txt").otherwise("_raw.txt"))
    return docs.select("doc_id", name.alias("name"))


@query(rf"""SELECT doc_id, array_to_string(list_transform(string_split(regexp_extract(name, '^(.+?)_(\d{{4}})_raw\.txt$', 1), '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS country,
CAST(regexp_extract(name, '^(.+?)_(\d{{4}})_raw\.txt$', 2) AS INTEGER) AS year FROM (SELECT doc_id, {_NAME} AS name FROM documents) WHERE regexp_matches(name, '^(.+?)_(\d{{4}})_raw\.txt$')""")
def filename_keys(spark, sf_dir):
    """Country and year of file names; names of other shapes are skipped."""
    country, year = segment.parse_filename(F.col("name"))
    return _names(spark, sf_dir).select("doc_id", country.alias("country"), year.alias("year")).where("country is not null")


@query(rf"""SELECT doc_id, regexp_extract(name, '^(.*?)_(\d{{4}})_', 1) AS slug, regexp_extract(name, '^(.*?)_(\d{{4}})_', 2) AS year FROM (SELECT doc_id, {_NAME} AS name FROM documents)""")
def filename_tokens(spark, sf_dir):
    slug, year = segment.parse_tokens(F.col("name"))
    return _names(spark, sf_dir).select("doc_id", slug.alias("slug"), year.alias("year"))


@query(r"""SELECT doc_id, replace(source, 'src', 'north_src') AS slug, CAST(2019 + doc_id % 7 AS VARCHAR) AS year FROM documents""")
def report_filename_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.replace("source", F.lit("src"), F.lit("north-src")), F.lit("-report-"), (2019 + F.col("doc_id") % 7).cast("string"), F.lit("_en.pdf"))
    slug, year = segment.parse_report_name(name)
    return docs.select("doc_id", slug.alias("slug"), year.alias("year"))


@query(r"""SELECT doc_id, 'north' AS country, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE CAST(2019 + doc_id % 7 AS VARCHAR) END AS year FROM documents""")
def loose_filename_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("north_"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), (2019 + F.col("doc_id") % 7).cast("string"))), F.lit(".pdf"))
    country, year = segment.parse_loose(name)
    return docs.select("doc_id", country.alias("country"), year.alias("year"))


def _paged(spark, sf_dir):
    """Each line is a page, marked by its number."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    pages = F.transform(F.split("text", "\n"), lambda p, i: F.concat(F.lit("===== PAGE "), (i + 1).cast("string"), F.lit(" =====\n"), p))
    return docs.select("doc_id", F.array_join(pages, "\n").alias("text"))


@query(rf"""SELECT doc_id, CAST(i + 1 AS INTEGER) AS page, page_text, {words_sql('page_text')} AS word_count FROM (
SELECT doc_id, unnest(range(len(c))) AS i, trim(unnest(c)) AS page_text FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL)) WHERE page_text <> ''""")
def page_chunk_table(spark, sf_dir):
    return segment.page_chunks(_paged(spark, sf_dir))


@query(ORACLES["page_chunk_table"])
def sql_page_chunks(spark, sf_dir):
    """Pages again, by the session's table function."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, p.* FROM {docs} d, LATERAL load_chunks(d.text) p", docs=_paged(spark, sf_dir))


@query(r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS pages FROM documents WHERE text IS NOT NULL""")
def page_counts(spark, sf_dir):
    return _paged(spark, sf_dir).select("doc_id", segment.page_count(F.col("text")).alias("pages"))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g'))) AS normal FROM documents WHERE text IS NOT NULL""")
def page_normalised(spark, sf_dir):
    """Page marks as blanks, single spaces, lower case."""
    return _paged(spark, sf_dir).select("doc_id", X.normalise_pages(F.col("text")).alias("normal"))


@query(rf"""WITH l AS (SELECT doc_id, i, trim(line) AS line FROM (SELECT doc_id, unnest(range(len(c))) AS i, unnest(c) AS line FROM (
  SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1))),
f AS (SELECT *, regexp_full_match(line, '(?:\d+\.?\d*\.?\s+[A-Z][A-Z\s\-]+|[Cc]hapter\s+\d+[:\s].*|[A-Z][A-Z\s/\-]{{14,}}|\*\s*\*\s*\*)\s*') AS head FROM l WHERE NOT regexp_full_match(line, '\d{{1,3}}')),
g AS (SELECT *, CAST(head OR line = '' OR coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY i), false) AS INTEGER) AS edge FROM f),
h AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS position FROM g),
p AS (SELECT doc_id, position, string_agg(line, ' ' ORDER BY i) AS raw_text, bool_or(head) AS is_header FROM h WHERE line <> '' GROUP BY doc_id, position),
q AS (SELECT doc_id, CAST(position AS BIGINT) AS position, raw_text, is_header, trim(regexp_replace(lower(raw_text), '\s+', ' ', 'g')) AS paragraph FROM p)
SELECT *, {words_sql('paragraph')} AS n_words FROM q WHERE {words_sql('paragraph')} >= 8""")
def labelled_paragraph_table(spark, sf_dir):
    """The line scanner; documents of odd id have a blank line after each line."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text")).alias("text"))
    return segment.labelled_paragraphs(docs, "doc_id")


_STARRED = "CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, chr(10), chr(10) || '* * *' || chr(10)) END"


def _starred(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    at = F.instr("text", "\n")
    cutting = F.when((F.col("doc_id") % 3 == 0) | (at == 0), F.col("text")).otherwise(F.concat(F.substr("text", F.lit(1), at), F.lit("* * *\n"), F.substr("text", at + 1)))
    return docs.select("doc_id", cutting.alias("text"))


@query(rf"""WITH t AS (SELECT doc_id, {_STARRED} AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, string_split_regex(text, '\s*\*\s*\*\s*\*\s*') AS c FROM t),
u AS (SELECT doc_id, '1.1_Context' AS section, trim(c[1], ' ' || chr(10)) AS section_text FROM s WHERE len(c) >= 2
UNION ALL SELECT doc_id, '1.2_Summary', trim(c[2], ' ' || chr(10)) FROM s WHERE len(c) >= 2
UNION ALL SELECT doc_id, 'Full_Summary', trim(text, ' ' || chr(10)) FROM s WHERE len(c) < 2)
SELECT *, {words_sql('section_text')} AS word_count FROM u""")
def star_section_table(spark, sf_dir):
    return segment.explode_sections(_starred(spark, sf_dir), segment.star_sections(F.col("text")))


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, chr(10), chr(10) || '1.2. ') END AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, text, string_split_regex(text, '\s*\*\s*\*\s*\*\s*') AS c, strpos(text, '1.2. ') AS pos FROM t),
u AS (SELECT doc_id, '1.1_Context' AS section, CASE WHEN len(c) >= 2 THEN c[1] WHEN pos > 1 THEN left(text, pos - 1) ELSE text END AS part FROM s
UNION ALL SELECT doc_id, '1.2_Summary', CASE WHEN len(c) >= 2 THEN c[2] ELSE substr(text, pos) END FROM s WHERE len(c) >= 2 OR pos > 1)
SELECT doc_id, section, trim(part, ' ' || chr(10)) AS section_text, {words_sql('part')} AS word_count FROM u""")
def header_section_table(spark, sf_dir):
    """Sections parted at the header 1.2."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    at = F.instr("text", "\n")
    cutting = F.when((F.col("doc_id") % 3 == 0) | (at == 0), F.col("text")).otherwise(F.concat(F.substr("text", F.lit(1), at), F.lit("1.2. "), F.substr("text", at + 1)))
    docs = docs.select("doc_id", cutting.alias("text"))
    return segment.explode_sections(docs, segment.header_sections(F.col("text")))


_WRAPPED = "'1.1. CONTEXT ' || text || ' 1.2. SUMMARY OF THE REPORT ' || text || ' CLUSTER 1 end'"


def _wrapped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.col("text").alias("own"), F.concat(F.lit("1.1. CONTEXT "), "text", F.lit(" 1.2. SUMMARY OF THE REPORT "), "text", F.lit(" CLUSTER 1 end")).alias("text"))


_FOOT = lambda t: rf"trim(regexp_replace(regexp_replace({t}, '(?i)page\s*\d+(\s+of\s+\d+)?', '', 'g'), '(?i)[a-z-]+\s+\d{{4}}\s+report', '', 'g'), ' ' || chr(10))"
_NEXT = r"1\.2\.?\s{0,4}\n?\s{0,4}(?:SUMMARY|MAIN\s+FINDINGS?|)"
_LAST = r"(?:1\.3[\.\s]|CLUSTER\s+1|THE\s+FUNDAMENTALS\s+OF\s+THE\s+ACCESSION|^2\.\s)"


@query(rf"""WITH t AS (SELECT doc_id, replace(replace('1.1. CONTEXT ' || text || ' 1.2. SUMMARY OF THE REPORT ' || text || ' CLUSTER 1 end', '∗', '*'), '* * *', '***') AS plain FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, substr(plain, 13) AS rest FROM t),
h AS (SELECT doc_id, rest, regexp_extract(rest, '(?is)\A(.*?){_NEXT}', 1) AS one, regexp_extract(rest, '(?is)\A.*?({_NEXT})', 1) AS head FROM r),
e AS (SELECT *, substr(rest, length(one) + length(head) + 51) AS tail FROM h),
f AS (SELECT *, CASE WHEN regexp_matches(tail, '(?ism){_LAST}') THEN substr(rest, length(one) + 1, length(head) + 50 + length(regexp_extract(tail, '(?ism)\A(.*?){_LAST}', 1))) ELSE substr(rest, length(one) + 1) END AS two FROM e)
SELECT doc_id, md5(regexp_replace({_FOOT("'1.1. CONTEXT' || one")} || '***' || {_FOOT('two')}, '\s+', '', 'g')) AS digest FROM f""")
def enlargement_slices(spark, sf_dir):
    """The text from 1.1 to its end; compared by a digest without white space."""
    got = segment.enlargement_sections(F.col("text"))
    return _wrapped(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(got, r"\s+", "").cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, trim(text, ' ' || chr(10)) AS findings FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1""")
def findings_slices(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    end = F.when(F.col("doc_id") % 2 == 0, " 2. The Fundamentals of the Accession Process").otherwise(" end")
    return docs.select("doc_id", segment.main_findings(F.concat(F.lit("x 1.2. Summary of the report "), "text", end)).alias("findings"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim('1.1 CONTEXT ' || plain) ELSE left(plain, 10000) END AS slice FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL)""")
def robust_slices(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x 1.1 CONTEXT "), "text", F.lit(" 2 CLUSTER 1 y"))).otherwise(F.col("text"))
    return docs.select("doc_id", segment.robust_slice(text).alias("slice"))


_SENTS = r"""parts AS (SELECT doc_id, unnest(range(len(c))) AS i, trim(unnest(c)) AS s FROM (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.\s+([A-Z])', chr(1) || '\1', 'g'), '\.\s+([A-Z])', chr(1) || '\1', 'g'), chr(1)) AS c FROM documents WHERE text IS NOT NULL)),
solid AS (SELECT * FROM parts WHERE s <> ''),
glue AS (SELECT *, coalesce(regexp_matches(lag(lower(s)) OVER (PARTITION BY doc_id ORDER BY i), '(^| )(no|viz|i\.e|e\.g|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|art|vol)$'), false) AS glued FROM solid),
runs AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM glue),
sents AS (SELECT doc_id, g, string_agg(s, '. ' ORDER BY i) AS s FROM runs GROUP BY doc_id, g),
good AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INTEGER) AS position, s || '.' AS sentence FROM sents WHERE length(s) >= 25)"""


@query(f"""WITH {_SENTS},
found AS (SELECT *, CASE WHEN contains(lower(sentence), 'of the') THEN 'market' WHEN contains(lower(sentence), 'that') THEN 'law' END AS topic_here,
CASE WHEN contains(lower(sentence), 'that the') OR contains(lower(sentence), 'of the') OR contains(lower(sentence), 'on the') THEN 'Action_Status'
 WHEN contains(lower(sentence), 'with') OR contains(lower(sentence), 'and') THEN 'Intention_Requirement' ELSE 'Description' END AS label FROM good)
SELECT doc_id, position, sentence, coalesce(last_value(topic_here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING), 'General') AS topic, label FROM found""")
def labelled_sentence_table(spark, sf_dir):
    """Sentences with the topic carried forward and a label."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return segment.labelled_sentences(docs, "doc_id", "text", {"law": ("that",), "market": ("of the",)}, L.PROXY_ACTIONS, L.PROXY_INTENTIONS)


@query(f"""WITH {_SENTS} SELECT doc_id, CAST(position // 5 AS INTEGER) AS chunk, string_agg(sentence, ' ' ORDER BY position) AS chunk_text FROM good GROUP BY doc_id, position // 5""")
def five_sentence_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    docs = docs.select("doc_id", segment.sentences(F.col("text")).alias("sents"))
    return docs.select("doc_id", F.posexplode(segment.fixed_chunks(F.col("sents"))).alias("chunk", "chunk_text"))


@query(r"""SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_extract(line, '^([A-Z][a-z]+) (.+)$', 1) AS num, trim(regexp_extract(line, '^([A-Z][a-z]+) (.+)$', 2)) AS title FROM (
SELECT doc_id, unnest(range(len(c))) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(line, '^([A-Z][a-z]+) (.+)$')""")
def header_lines(spark, sf_dir):
    """Lines that match a header pattern, with its two groups."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return segment.line_headers(docs, "doc_id", r"^([A-Z][a-z]+) (.+)$")


def _fold_sql(text: str, rules) -> str:
    for pattern, by in rules:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


_STRUCT_SQL = _fold_sql("text", [(r"(?m)^={3,}[^\n]*={3,}$", " "), (r"(?m)^[^\n]+\.{4,}\s*\d+\s*$", " "), (r"\*\s*\*\s*\*", " "), (r"(?m)^\s*\d{1,3}\s*$", " "), (r"(?m)^\s*\d+\.?\d*\.?\s+[A-Z][A-Z\s\-]+\s*$", " "), (r"(?m)^[Cc]hapter\s+\d+[:\s][^\n]*$", " "), (r"(?m)^[A-Z][A-Z\s/\-]{14,}$", " "), ("→", " ")])
_CLEAN_SQL = _fold_sql("low", [(r"(?s)the report uses the following assessment scale.*?interim steps have also been used\.?", " "), (r"(?s)this report covers the period from.*?in particular in the area of rule of law\.?", " "), (r"the commission.s recommendations from last year[^\n]*\.", " "), (r"in the coming year,\s+[\p{L}\p{N}_][\p{L}\p{N}_\s,]+(?:should|needs|need to)[^\n]*", " "), (r"([\p{L}\p{N}\p{M}_])\d{1,2}([\s,.])", r"\1 \2"), (r"\s+", " ")])


@query(rf"""WITH a AS (SELECT doc_id, text, lower({_STRUCT_SQL}) AS low FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, text, low, trim({_CLEAN_SQL}) AS clean FROM a)
SELECT doc_id, {words_sql('text')} AS raw_words, {words_sql('low')} AS after_structural, {words_sql('clean')} AS final_words, clean FROM b""")
def cleaned_text(spark, sf_dir):
    """Two-phase cleaning, with word counts before, between and after."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    out = docs.select("doc_id", X.word_count(F.col("text")).alias("raw_words"), X.word_count(X.drop_structure(F.col("text"))).alias("after_structural"), X.clean_text(F.col("text")).alias("clean"))
    return out.withColumn("final_words", X.word_count(F.col("clean")))


@query(rf"""WITH a AS (SELECT doc_id, text, lower({_STRUCT_SQL}) AS low FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, {words_sql('text')} AS r, {words_sql('low')} AS m, {words_sql(f'trim({_CLEAN_SQL})')} AS f FROM a)
SELECT doc_id, r AS raw_words, m AS after_structural, f AS final_words, r - m AS structural_removed, m - f AS boilerplate_removed, r - f AS total_removed, CASE WHEN r > 0 THEN round(100.0::DOUBLE * (r - f) / r, 1) ELSE 0.0::DOUBLE END AS pct_removed FROM b""")
def cleaning_reports(spark, sf_dir):
    """Word counts of all documents before, between and after the phases."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.cleaning_report(F.col("text")).alias("r")).select("doc_id", "r.*")


_SECTION_SQL = _fold_sql("'3' || chr(10) || '1. INTRODUCTION2 1.1. CONTEXT 1.2 Summary of  the report Cluster 4: ' || text || ' word12 ' || chr(10) || ' 17 '", [
    (r"(?m)^\s*\d{1,3}\s*$", ""), (r"([\p{L}\p{N}\p{M}_])\d{1,2}(\s)", r"\1\2"), (r"(?i)1\s*\.\s*introduction[12]?\s*", ""), (r"(?i)1\s*\.1\.?\s*context\s*", ""),
    (r"(?i)1\s*\.2\.?\s*(main\s+findings\s+of\s+the\s+report|summary\s+of\s+the\s+report)\s*", ""), (r"(?i)cluster\s+\d+\s*[:–\-]\s*", ""), (r"\s+", " ")])


@query(f"SELECT doc_id, lower(trim({_SECTION_SQL})) AS section FROM documents WHERE text IS NOT NULL")
def cleaned_sections(spark, sf_dir):
    """The section cleaner, over texts with page numbers, footnote digits and headings put in."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    put_in = F.concat(F.lit("3\n1. INTRODUCTION2 1.1. CONTEXT 1.2 Summary of  the report Cluster 4: "), "text", F.lit(" word12 \n 17 "))
    return docs.select("doc_id", X.clean_section(put_in).alias("section"))


@query(rf"""WITH {REPORTS} SELECT country, year, doc_id, {words_sql('text')} AS word_count, country || ' (' || year || ')' AS label FROM reports""")
def document_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    year = (2019 + F.col("doc_id") % 7).cast("int")
    return docs.select(F.col("source").alias("country"), year.alias("year"), "doc_id", X.word_count(F.col("text")).alias("word_count"), F.concat("source", F.lit(" ("), year.cast("string"), F.lit(")")).alias("label"))


@query(r"""SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', '', 'g')) AS plain FROM documents WHERE text IS NOT NULL""")
def punctuation_free(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.drop_punctuation(F.col("text")).alias("plain"))


@query(r"""SELECT doc_id, trim(regexp_replace(text || ' "it''s" - "', '\s+', ' ', 'g')) AS fixed FROM documents WHERE text IS NOT NULL""")
def repaired_encoding(spark, sf_dir):
    """Soft hyphens and wrong decodings are put in and taken out again."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    broken = F.concat(F.replace(F.col("text"), F.lit("th"), F.lit("t\xadh")), F.lit(" â€œitâ€™sâ€\u009d â€“ â€œ"))
    return docs.select("doc_id", X.fix_encoding(broken).alias("fixed"))


@query(rf"""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS types, round(CAST(len(list_distinct(t)) AS DOUBLE) / len(t), 4) AS ttr,
round(CAST(len(list_distinct(t[1:200])) AS DOUBLE) / len(t[1:200]), 4) AS sttr_200, h.hapax, round(CAST(h.hapax AS DOUBLE) / len(list_distinct(t)) * 100, 1) AS hapax_pct FROM (
SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS t FROM documents WHERE text IS NOT NULL)
JOIN (SELECT doc_id, CAST(count(*) FILTER (n = 1) AS BIGINT) AS hapax FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY doc_id, w) GROUP BY doc_id) h USING (doc_id)""")
def vocabulary_richness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    out = docs.select("doc_id", S.vocabulary(X.words(F.lower("text"))).alias("v")).where("v.tokens is not null")
    return out.select("doc_id", F.col("v.tokens").cast("long").alias("tokens"), F.col("v.types").cast("long").alias("types"), "v.ttr", "v.sttr_200", F.col("v.hapax").cast("long").alias("hapax"), "v.hapax_pct")


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda t: t NOT IN ('the', 'and', 'that')) AS tokens FROM documents WHERE text IS NOT NULL""")
def model_token_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", segment.model_tokens(F.col("text"), ("the", "and", "that")).alias("tokens"))


@query(r"""WITH p AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS page, page_text FROM (SELECT doc_id, unnest(range(len(c))) AS i, trim(unnest(c)) AS page_text FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL)) WHERE page_text <> ''),
b AS (SELECT *, min(page) FILTER (contains(page_text, 'with') AND page BETWEEN 2 AND 11) OVER (PARTITION BY doc_id) AS b FROM p),
e AS (SELECT *, coalesce(min(page) FILTER (page > b AND contains(page_text, 'that')) OVER (PARTITION BY doc_id), b + 20) AS e FROM b WHERE b IS NOT NULL)
SELECT doc_id, page, page_text FROM e WHERE page >= b AND page < e""")
def page_windows(spark, sf_dir):
    """Pages from the first that has one phrase to before the next that has another."""
    pages = segment.page_chunks(_paged(spark, sf_dir)).drop("word_count")
    return segment.page_window(pages, "doc_id", "with", "that")


@query("SELECT doc_id, (contains(coalesce(CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' END, ''), 'pdf') OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS accepted FROM documents")
def accepted_downloads(spark, sf_dir):
    """The download rule over response metadata."""
    from tonemill.sources.readers import accepted_download

    i = F.col("doc_id")
    kind, name, url = F.when(i % 2 == 0, "application/PDF"), F.when(i % 3 == 0, "attachment; filename=x.pdf"), F.when(i % 5 == 0, "http://h/x.pdf").otherwise("http://h/x")
    return table(spark, sf_dir, "documents").select("doc_id", accepted_download(kind, name, url).alias("accepted"))
