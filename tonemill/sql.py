"""The operators for users of SQL: scalar and table functions of the session, written in SQL, so that all of them run in the JVM.

    register(spark)
    spark.sql("SELECT d.doc_id, p.* FROM documents d, LATERAL build_corpus(d.text, 50, 500) p")

Scalar functions: word_count, raw_count, dict_score, severity. Table functions: build_corpus (paragraph_id, paragraph_text,
word_count), load_chunks (page, page_text, word_count), segment_by_sentences (position, sentence). A null text gives no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tonemill.lexicons import ABBREVIATIONS, MOJIBAKE
from tonemill.operators.segment import PAGE_MARK


def _raw(pattern: str) -> str:
    return "r'" + pattern + "'"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


# SQL functions cannot be called inside lambdas, so these parts are put in as text.
def _words(t: str) -> str:
    return f"size(filter(split({t}, r'(?U)\\s+'), w -> w <> ''))"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, r'(?U)^\\s+|\\s+$', '')"


def _hits(lower: str, term: str) -> str:
    return f"CAST((length({lower}) - length(replace({lower}, {term}, ''))) div length({term}) AS BIGINT)"


_COUNT = f"element_at(transform(array(lower(t)), l -> aggregate(terms, 0L, (n, x) -> n + {_hits('l', 'x')})), 1)"

_CANDIDATES = (
    f"transform(split(regexp_replace(replace(regexp_replace(t, {_raw(PAGE_MARK)}, ''), '  \\n', '\\n\\n'), r'([A-Za-z]{{4,}}[.!?]) \\n(?=[A-Z→])', '$1\\n\\n'), r'\\n{{2,}}'),"
    f" c -> {_strip('replace(c, chr(10), chr(32))')})"
)
_LONG = (
    "aggregate(split(s.piece, r'(?<=[.!?])(?U)\\s+'), named_struct('done', CAST(array() AS ARRAY<STRING>), 'now', CAST(NULL AS STRING), 'n', 0),"
    f" (a, x) -> if(a.n + {_words('x')} >= most,"
    " named_struct('done', concat(a.done, array(concat_ws(' ', a.now, x))), 'now', CAST(NULL AS STRING), 'n', 0),"
    f" named_struct('done', a.done, 'now', concat_ws(' ', a.now, x), 'n', a.n + {_words('x')})),"
    " a -> if(a.now IS NULL, a.done, concat(a.done, array(a.now))))"
)
_COUNTED = lambda pieces: f"filter(transform({pieces}, c -> named_struct('piece', c, 'n', {_words('c')})), s -> s.n >= least)"
_CORPUS = f"flatten(transform({_COUNTED(_CANDIDATES)}, s -> if(s.n > most, {_COUNTED(_LONG).replace('s -> s.n', 'q -> q.n')}, array(s))))"

_BODIES = f"slice(transform(split(t, {_raw(PAGE_MARK)}), b -> {_strip('b')}), 2, 1000000000)"
_NUMBERS = f"regexp_extract_all(t, {_raw(PAGE_MARK.replace(chr(92) + 'd+', '(' + chr(92) + 'd+)'))}, 1)"
_PAGES = f"filter(zip_with({_NUMBERS}, {_BODIES}, (n, b) -> named_struct('page', CAST(n AS INT), 'body', b)), p -> p.body <> '')"


def _fixed_encoding(t: str) -> str:
    for old, new in MOJIBAKE:
        t = f"replace({t}, {_text(old)}, {_text(new)})"
    return f"trim(regexp_replace({t}, r'(?U)\\s+', ' '))"


_ABBREVIATED = "(?:\\\\A| )(?:" + "|".join(a.replace(".", "\\\\.") for a in ABBREVIATIONS) + ")\\\\z"
_PARTS = f"filter(transform(split({_fixed_encoding('t')}, r'\\.(?U:\\s+)(?=[A-Z])'), c -> {_strip('c')}), s -> s <> '')"
_STARTS = f"filter(sequence(0, size(p) - 1), i -> i = 0 OR NOT rlike(lower(get(p, i - 1)), '{_ABBREVIATED}'))"
_JOINED = "transform(b, (i, j) -> array_join(slice(p, i + 1, coalesce(get(b, j + 1), size(p)) - i), '. '))"
_SENTENCES = f"transform(filter(flatten(transform(filter(array({_PARTS}), p -> size(p) > 0), p -> flatten(transform(array({_STARTS}), b -> {_JOINED})))), s -> length(s) >= least), s -> concat(s, '.'))"

FUNCTIONS = {
    "word_count(t STRING) RETURNS INT": _words("t"),
    "raw_count(t STRING, terms ARRAY<STRING>) RETURNS BIGINT": _COUNT,
    "dict_score(t STRING, terms ARRAY<STRING>) RETURNS DOUBLE": f"CASE WHEN {_words('t')} > 0 THEN {_COUNT} / {_words('t')} * 1000 ELSE 0D END",
    "severity(hard DOUBLE, soft DOUBLE) RETURNS DOUBLE": "CASE WHEN soft > 0 THEN hard / soft END",
    "build_corpus(t STRING, least INT, most INT) RETURNS TABLE(paragraph_id INT, paragraph_text STRING, word_count INT)": f"SELECT pos, p.piece, p.n FROM (SELECT posexplode({_CORPUS}) AS (pos, p))",
    "load_chunks(t STRING) RETURNS TABLE(page INT, page_text STRING, word_count INT)": f"SELECT p.page, p.body, {_words('p.body')} FROM (SELECT explode({_PAGES}) AS p)",
    "segment_by_sentences(t STRING, least INT) RETURNS TABLE(position INT, sentence STRING)": f"SELECT pos, s FROM (SELECT posexplode({_SENTENCES}) AS (pos, s))",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, in place of earlier ones of these names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
