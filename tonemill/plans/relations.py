"""Queries: joins, windows, ranking, sets, links and term vectors."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.operators import aggregate as A
from tonemill.operators import html as H
from tonemill.operators import relate as R
from tonemill.operators import segment as G
from tonemill.operators import vectors as V
from tonemill.operators.scan import scanned
from tonemill.plans.adapter import PARAS, REPORTS, SCORED, count_sql, paragraphs, reports, scored, table, words_sql
from tonemill.plans.registry import query
from tonemill.sources import manifest
from tonemill.session import shared_folder

_GROUPS = {k: v for k, v in L.PROXY_GROUPS.items()}
_KW = f"kw AS (SELECT country, year, {', '.join(f'''sum({count_sql('lower(text)', v)})::BIGINT AS {k}''' for k, v in _GROUPS.items())} FROM reports GROUP BY country, year)"


def _keywords(spark, sf_dir):
    return reports(spark, sf_dir).groupBy("country", "year").agg(*(F.sum(S.raw_count(F.col("text"), v)).alias(k) for k, v in _GROUPS.items()))


@query(f"WITH {REPORTS}, {_KW}, d AS (SELECT country, year, count(*) AS docs FROM reports WHERE year > 2020 GROUP BY country, year) SELECT kw.*, CAST(d.docs AS DOUBLE) AS docs FROM kw LEFT JOIN d USING (country, year)")
def keyword_driver_join(spark, sf_dir):
    """A left join on two keys."""
    docs = reports(spark, sf_dir).where("year > 2020").groupBy("country", "year").agg(F.count(F.lit(1)).cast("double").alias("docs"))
    return _keywords(spark, sf_dir).join(docs, ["country", "year"], "left")


@query(f"WITH {SCORED}, s AS (SELECT country, round(avg(criticism_hard_p1k), 4) AS hard FROM scored GROUP BY country), w AS (SELECT country, round(avg(criticism_soft_p1k), 4) AS soft FROM scored WHERE year < 2023 GROUP BY country) SELECT country, hard, soft FROM s JOIN w USING (country)")
def inner_join_means(spark, sf_dir):
    df = scored(spark, sf_dir)
    a = df.groupBy("country").agg(F.round(F.avg("criticism_hard_p1k"), 4).alias("hard"))
    return a.join(df.where("year < 2023").groupBy("country").agg(F.round(F.avg("criticism_soft_p1k"), 4).alias("soft")), "country")


@query(f"WITH {SCORED}, s AS (SELECT country, year, round(avg(criticism_hard_p1k), 4) AS hard FROM scored GROUP BY country, year), w AS (SELECT country, year, round(avg(criticism_soft_p1k), 4) AS soft FROM scored WHERE word_count < 100 GROUP BY country, year) SELECT country, year, hard, soft FROM s JOIN w USING (country, year)")
def inner_join_on_two_keys(spark, sf_dir):
    df = scored(spark, sf_dir)
    a = df.groupBy("country", "year").agg(F.round(F.avg("criticism_hard_p1k"), 4).alias("hard"))
    return a.join(df.where("word_count < 100").groupBy("country", "year").agg(F.round(F.avg("criticism_soft_p1k"), 4).alias("soft")), ["country", "year"])


@query(f"WITH {REPORTS}, c AS (SELECT DISTINCT country FROM reports), y AS (SELECT DISTINCT year FROM reports), k AS (SELECT DISTINCT doc_id % 13 AS kind FROM reports) SELECT country, year, kind FROM c, y, k EXCEPT SELECT country, year, doc_id % 13 FROM reports")
def missing_coverage(spark, sf_dir):
    """Cells of the grid of entity, year and kind without a document."""
    return R.missing_cells(reports(spark, sf_dir).select("country", "year", (F.col("doc_id") % 13).alias("kind")), ["country", "year", "kind"])


@query(f"WITH {REPORTS}, known AS (SELECT DISTINCT country, year FROM reports JOIN labels USING (doc_id) WHERE quality = 1), grid AS (SELECT country, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT country FROM reports), range(2019, 2026) t(y)) SELECT grid.country, grid.year, CASE WHEN known.country IS NULL THEN 'missing' ELSE 'downloaded' END AS status FROM grid LEFT JOIN known USING (country, year)")
def download_grid(spark, sf_dir):
    """Every entity in every year with a status: downloaded where a document of it was found to be good."""
    docs = reports(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    known = docs.drop("text").join(good, "doc_id", "left_semi").select("country", "year").distinct().withColumn("status", F.lit("downloaded"))
    return R.task_grid(docs, "country", 2019, 2025, known)


@query(f"WITH {REPORTS}, k AS (SELECT country, year, count(*) AS n FROM reports WHERE year <> 2021 GROUP BY country, year), grid AS (SELECT country, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT country FROM k), range(2019, 2026) t(y)) SELECT country, year, CAST(n AS DOUBLE) AS n FROM grid LEFT JOIN k USING (country, year)")
def gap_filled_years(spark, sf_dir):
    k = reports(spark, sf_dir).where("year <> 2021").groupBy("country", "year").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return R.dense_years(k, "country", 2019, 2025)


@query(f"WITH {SCORED}, a AS (SELECT country, round(avg(criticism_hard_p1k), 3) AS v FROM scored WHERE year < 2022 GROUP BY country), b AS (SELECT country, round(avg(criticism_hard_p1k), 3) AS v FROM scored WHERE country <> 'src1' GROUP BY country) SELECT country, a.v AS early, b.v AS whole FROM a FULL JOIN b USING (country)")
def outer_bind(spark, sf_dir):
    """Columns aligned on a key from either side."""
    df = scored(spark, sf_dir)
    mean = lambda d: d.groupBy("country").agg(F.round(F.avg("criticism_hard_p1k"), 3).alias("v"))
    return R.outer_bind({"early": mean(df.where("year < 2022")), "whole": mean(df.where("country <> 'src1'"))}, "country", "v")


_NAMES = {"src1": "First", "src2": "Second", "src3": "Third"}


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'First' WHEN 'src2' THEN 'Second' WHEN 'src3' THEN 'Third' ELSE upper(source[1]) || source[2:] END AS label FROM documents")
def display_labels(spark, sf_dir):
    """A dictionary lookup with a fallback."""
    lookup = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(lookup, F.col("source")), X.title_label(F.col("source"))).alias("label"))


@query("SELECT doc_id, name AS label FROM documents d LEFT JOIN (VALUES ('src1', 'First'), ('src2', 'Second'), ('src3', 'Third')) t(code, name) ON d.source = t.code")
def dictionary_join(spark, sf_dir):
    """The same lookup as a join with a table of fixed size."""
    names = spark.createDataFrame(list(_NAMES.items()), "source string, label string")
    return table(spark, sf_dir, "documents").join(F.broadcast(names), "source", "left").select("doc_id", "label")


_HEADS = r"""l AS (SELECT doc_id, unnest(range(len(c))) AS i, unnest(c) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents WHERE text IS NOT NULL)),
marks AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, length(line) AS page FROM l WHERE i % 3 = 1), heads AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, line AS title FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+ ')) """


@query(f"WITH {_HEADS} SELECT h.doc_id, h.line_no, h.title, coalesce(m.page, 1) AS page FROM heads h ASOF LEFT JOIN marks m ON h.doc_id = m.doc_id AND h.line_no >= m.line_no")
def header_pages(spark, sf_dir):
    """As-of join: each header with the last page mark at or before it, 1 before the first."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    heads = lines.where(F.col("line").rlike("^[A-Z][a-z]+ ")).select("doc_id", "line_no", F.col("line").alias("title"))
    marks = lines.where("line_no % 3 = 1").select("doc_id", "line_no", F.length("line").cast("long").alias("page"))
    return R.as_of(heads, marks, "doc_id", "line_no", "line_no", "page", 1)


@query("SELECT c.event_id, c.user_id, c.ts, p.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON c.user_id = p.user_id AND c.ts >= p.ts")
def last_purchase(spark, sf_dir):
    """As-of join over a larger table: each event with the user's last purchase."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return R.as_of(e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), buys, "user_id", "ts", "ts", "last_value")


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, count(*) OVER (PARTITION BY doc_id ORDER BY paragraph_id) - 1 AS running, sum(word_count) OVER (PARTITION BY doc_id ORDER BY paragraph_id)::BIGINT AS words_so_far FROM paras")
def running_counts(spark, sf_dir):
    """Counters that run over a document's paragraphs."""
    p = scanned(paragraphs(spark, sf_dir).select("doc_id", "paragraph_id", "word_count"), ["doc_id"], ["paragraph_id"], sums={"words_so_far": "word_count"}, number="n")
    return p.select("doc_id", "paragraph_id", (F.col("n") - 1).alias("running"), "words_so_far")


_DIFF = ", ".join(f"{k} - lag({k}) OVER (PARTITION BY country ORDER BY year) AS {k}" for k in _GROUPS)


@query(f"WITH {REPORTS}, {_KW}, d AS (SELECT country, year, {_DIFF} FROM kw) SELECT * FROM d WHERE {' AND '.join(f'{k} IS NOT NULL' for k in _GROUPS)}")
def year_over_year(spark, sf_dir):
    return R.changes(_keywords(spark, sf_dir), "country", "year", list(_GROUPS))


@query(f"WITH {REPORTS}, {_KW}, d AS (SELECT country, year, {_DIFF} FROM kw), u AS (" + " UNION ALL ".join(f"SELECT country, year, '{k}' AS driver, CAST({k} AS DOUBLE) AS change FROM d WHERE {k} IS NOT NULL" for k in _GROUPS) + ") SELECT country, year, driver, change, CAST(row_number() OVER (PARTITION BY country, year ORDER BY abs(change) DESC, driver) AS INTEGER) AS rank FROM u QUALIFY rank <= 2")
def largest_drivers(spark, sf_dir):
    """The two drivers that changed most each year."""
    return R.largest_changes(_keywords(spark, sf_dir), "country", "year", list(_GROUPS), 2)


_CHANGES = f"WITH {REPORTS}, {_KW}, d AS (SELECT country, year, {_DIFF} FROM kw), u AS (" + " UNION ALL ".join(f"SELECT country, year, '{k}' AS driver, CAST({k} AS DOUBLE) AS change FROM d WHERE {k} IS NOT NULL" for k in _GROUPS) + ")"


@query(f"{_CHANGES} SELECT country, year, driver, change, CAST(row_number() OVER (PARTITION BY country, year ORDER BY abs(change) DESC, driver) AS INTEGER) AS rank FROM u QUALIFY rank <= 3")
def three_largest_drivers(spark, sf_dir):
    """The three drivers that changed most each year."""
    return R.largest_changes(_keywords(spark, sf_dir), "country", "year", list(_GROUPS))


_STATUS = "source string, doc_id long, attempt int, status string"


@query("SELECT source, doc_id, CASE WHEN quality = 1 THEN 2 ELSE 1 END::INTEGER AS attempt, CASE WHEN quality = 1 THEN 'downloaded' ELSE 'failed' END AS status FROM documents JOIN labels USING (doc_id)")
def manifest_statuses(spark, sf_dir):
    """A manifest merged by three runs: all labelled documents failed, then the good ones came, then the first run was repeated."""
    found = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/manifest"
    first = found.select("source", "doc_id", F.lit(1).alias("attempt"), F.lit("failed").alias("status"))
    second = found.where("quality = 1").select("source", "doc_id", F.lit(2).alias("attempt"), F.lit("downloaded").alias("status"))
    for run in (first, second, first):
        manifest.merge(run, path, _STATUS, ["source", "doc_id"], "source")
    return manifest.read(spark, path, _STATUS)


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'none') AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn)")
def carried_questions(spark, sf_dir):
    """The last user turn carried forward."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    c = c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("text")).alias("own"))
    c = scanned(c, ["conv_id"], ["turn"], last={"asked": "own"}, before={"before": "role"})
    return c.select("conv_id", "turn", F.coalesce("asked", F.lit("none")).alias("asked"), "before")


@query(f"WITH {SCORED}, s AS (SELECT country, year, round(avg(criticism_hard_p1k), 4) AS m FROM scored GROUP BY country, year) SELECT country, arg_max(year, (m, -year)) AS year, max(m) AS m FROM s GROUP BY country")
def peak_year(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("country", "year").agg(F.round(F.avg("criticism_hard_p1k"), 4).alias("m"))
    return R.peak(s, "country", "m", "year")


@query(f"WITH {SCORED}, s AS (SELECT country, year, round(avg(criticism_hard_p1k), 4) AS m FROM scored GROUP BY country, year) SELECT country, year, m FROM s QUALIFY year = max(year) OVER (PARTITION BY country)")
def latest_year(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("country", "year").agg(F.round(F.avg("criticism_hard_p1k"), 4).alias("m"))
    return R.latest(s, "country", "year")


@query(f"WITH {REPORTS}, n AS (SELECT country, count(*) AS n FROM reports GROUP BY country) SELECT country, n, sum(n) OVER (ORDER BY country)::BIGINT AS upto FROM n")
def block_boundaries(spark, sf_dir):
    """Cumulative group sizes, scanned over range partitions: no task has all entities."""
    n = reports(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return scanned(n, [], ["country"], sums={"upto": "n"})


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, word_count FROM paras ORDER BY word_count DESC, doc_id, paragraph_id LIMIT 5")
def longest_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_id", "word_count").orderBy(F.desc("word_count"), "doc_id", "paragraph_id").limit(5)


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, word_count FROM paras ORDER BY word_count, doc_id, paragraph_id LIMIT 5")
def shortest_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_id", "word_count").orderBy("word_count", "doc_id", "paragraph_id").limit(5)


@query(f"WITH {PARAS}, s AS (SELECT country, count(*) AS n FROM paras GROUP BY country) SELECT country, n, CAST(row_number() OVER (ORDER BY n DESC, country) AS INTEGER) AS place FROM s QUALIFY place <= 5 OR place > (SELECT count(*) FROM s) - 5")
def head_and_tail(spark, sf_dir):
    """First and last five of an order over entities."""
    s = paragraphs(spark, sf_dir).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    placed = scanned(s, [], [F.desc("n"), "country"], number="at")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    return placed.crossJoin(F.broadcast(total)).where("at <= 5 or at > total - 5").select("country", "n", F.col("at").cast("int").alias("place"))


@query("SELECT d.doc_id, r.rank FROM documents d JOIN (VALUES ('src3', 1), ('src1', 2), ('src2', 3)) r(source, rank) USING (source)")
def external_order(spark, sf_dir):
    """Rows ranked by an order given from outside."""
    ranks = spark.createDataFrame([("src3", 1), ("src1", 2), ("src2", 3)], "source string, rank int")
    return table(spark, sf_dir, "documents").join(F.broadcast(ranks), "source").select("doc_id", "rank").orderBy("rank", "doc_id")


_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}'), lambda t: t NOT IN ('the', 'of', 'and'))"
_BI = f"b AS (SELECT source, doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM (SELECT source, doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL))"
_STOPS = ("the", "of", "and")


def _top_bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", G.vector_tokens(F.col("text"), _STOPS).alias("t"))
    return V.heavy_terms(d, "source", "t", 50, 2, 2).withColumnRenamed("tf", "n")


_TOP = f"{_BI}, n AS (SELECT source, term, count(*) AS n FROM b GROUP BY source, term), top AS (SELECT source, term, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS INTEGER) AS rank FROM n QUALIFY rank <= 50)"


@query(f"WITH {_TOP} SELECT * FROM top")
def top_bigrams(spark, sf_dir):
    return _top_bigrams(spark, sf_dir)


@query(f"WITH {_BI.replace('SELECT source, doc_id, unnest', 'SELECT doc_id % 7 AS year, unnest').replace('AS term FROM (SELECT source,', 'AS term FROM (SELECT')}, n AS (SELECT year, term, count(*) AS n FROM b GROUP BY year, term), top AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, term) <= 50) SELECT term FROM top GROUP BY term HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM top)")
def shared_bigrams(spark, sf_dir):
    """Top bigrams of every year (intersection)."""
    d = table(spark, sf_dir, "documents").where("text is not null").select((F.col("doc_id") % 7).alias("year"), G.vector_tokens(F.col("text"), _STOPS).alias("t"))
    return R.in_all(V.heavy_terms(d, "year", "t", 50, 2, 2), "year", "term")


@query(f"WITH {_TOP} SELECT min(source) AS source, term FROM top GROUP BY term HAVING count(DISTINCT source) = 1")
def unique_bigrams(spark, sf_dir):
    """Top bigrams of one entity alone (difference from the union of others)."""
    return R.in_one(_top_bigrams(spark, sf_dir), "source", "term")


@query("SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents WHERE source = 'src1' UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) FROM documents WHERE source = 'src2')")
def union_without_repeats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    terms = lambda s: d.where(F.col("source") == s).select(F.explode(G.model_tokens(F.col("text"))).alias("term"))
    return terms("src1").unionByName(terms("src2")).distinct()


@query(f"WITH {PARAS} SELECT 'raw' AS kind, count(*) AS n FROM lines UNION ALL SELECT 'kept', count(*) FROM paras")
def union_of_stages(spark, sf_dir):
    docs = reports(spark, sf_dir)
    n = lambda kind, low: G.build_corpus(docs, "text", low, 10**9).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return reduce(lambda a, b: a.unionByName(b), [n("raw", 0), n("kept", 50)])


@query(r"""WITH a AS (SELECT page_id, unnest(range(len(m))) AS i, unnest(m) AS m FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>') AS m FROM pages))
SELECT page_id, CAST(i AS INTEGER) AS position, regexp_extract(m, '(?is)href\s*=\s*"([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(m, '(?is)<a\b[^>]*>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS label FROM a""")
def page_links(spark, sf_dir):
    return R.anchors(table(spark, sf_dir, "pages"))


_ANCHORS = r"""a AS (SELECT page_id, url, unnest(range(len(m))) AS i, unnest(m) AS m FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>') AS m FROM pages)),
l AS (SELECT page_id, CAST(i AS INTEGER) AS position, href, regexp_extract(url, '^[^:]+://[^/?#]*') || href AS target, label
  FROM (SELECT page_id, url, i, regexp_extract(m, '(?is)href\s*=\s*"([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(m, '(?is)<a\b[^>]*>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS label FROM a))"""


@query(f"WITH {_ANCHORS} SELECT * FROM l")
def html_links(spark, sf_dir):
    """All links by the tokenizer, in any quoting, with entities decoded and targets joined to the page's url."""
    return H.page_links(table(spark, sf_dir, "pages"))


@query(f"WITH {_ANCHORS} SELECT trim(regexp_replace(label, ' [^ ]+$', '')) AS name, arg_max(target, page_id * 10000 + position) AS target FROM l WHERE regexp_full_match(label, '[^ ]+( [^ ]+)?') AND NOT contains(label, '(') GROUP BY name")
def targets_by_label(spark, sf_dir):
    """Targets by label: links whose label is one or two words, by its first word; the last link of the last page wins."""
    return H.targets_by_label(H.page_links(table(spark, sf_dir, "pages")), r"[^ ]+(?: [^ ]+)?", r" [^ ]+", [F.col("page_id"), F.col("position")], "(")


_LINKS = r"""links AS (SELECT page_id, i, regexp_extract(m, '(?is)href\s*=\s*"([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(range(len(m))) AS i, unnest(m) AS m FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>.*?</a>') AS m FROM pages)))"""


@query(f"WITH {_LINKS} SELECT page_id, coalesce(arg_min(href, i) FILTER (ends_with(href, 'ing')), arg_min(href, i) FILTER (contains(lower(href), 'th'))) AS href FROM links GROUP BY page_id HAVING coalesce(arg_min(href, i) FILTER (ends_with(href, 'ing')), arg_min(href, i) FILTER (contains(lower(href), 'th'))) IS NOT NULL")
def preferred_links(spark, sf_dir):
    """The first link of one kind, else the first of another."""
    return R.preferred_link(R.anchors(table(spark, sf_dir, "pages")), "page_id", F.col("href").endswith("ing"), F.lower("href").contains("th"))


@query(f"WITH {_LINKS} SELECT href, arg_max(page_id, page_id * 1000 + i) AS page_id FROM links WHERE regexp_full_match(href, '/[a-z]+') AND NOT contains(href, 'ing') GROUP BY href")
def last_page_by_link(spark, sf_dir):
    """A full-match filter with an exclusion; the last row wins by key."""
    links = R.anchors(table(spark, sf_dir, "pages")).where(F.col("href").rlike("^/[a-z]+$") & ~F.contains("href", F.lit("ing")))
    return links.groupBy("href").agg(F.max_by("page_id", F.struct("page_id", "position")).alias("page_id"))


@query(r"""SELECT page_id, regexp_replace(url || '/report-2021_en', 'report-\d{4}_en$', 'report-' || (2019 + page_id % 7) || '_en') AS year_url, (contains(lower(url), 'html') OR ends_with(url, '/')) AS accepted FROM pages WHERE url IS NOT NULL""")
def year_urls(spark, sf_dir):
    """A year put into a url, and an acceptance rule."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    new = F.regexp_replace(F.concat("url", F.lit("/report-2021_en")), F.lit(r"report-\d{4}_en$"), F.concat(F.lit("report-"), (2019 + F.col("page_id") % 7).cast("string"), F.lit("_en")))
    return p.select("page_id", new.alias("year_url"), (F.lower("url").contains("html") | F.col("url").endswith("/")).alias("accepted"))


@query(f"WITH g AS (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)) SELECT term, count(*) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 20")
def top_ngrams(spark, sf_dir):
    """The twenty most frequent words and bigrams."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", G.vector_tokens(F.col("text"), _STOPS).alias("t"))
    return V.top_terms(V.term_frequencies(d, "t", 1, 2), 20)


def _tfidf_sql(counts: str, max_df: float, features: int, tf: str) -> str:
    return f"""{counts}, nd AS (SELECT count(DISTINCT doc) AS n FROM c),
v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term HAVING count(*) <= {max_df} * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT {features}),
x AS (SELECT doc, term, tf, ({tf}) * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS x FROM c JOIN v USING (term), nd),
w AS (SELECT doc, term, tf, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS tfidf FROM x)"""


_UNI = f"c AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)) GROUP BY doc, term)"
_POOL = f"pool AS (SELECT source AS doc, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY source), c AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM (SELECT doc, {_TOKENS} AS t FROM pool)) GROUP BY doc, term)"


_POOL_TRI = _POOL.replace("range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]", "range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]")


def _pooled(spark, sf_dir, features, max_df=1.0, n=2, sublinear=False):
    """Weights of n-grams of each entity's texts end to end, without joining them: those inside texts, and those across texts' borders."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("doc"), "doc_id", G.vector_tokens(F.col("text"), _STOPS).alias("t"))
    return V.pooled_tfidf(d, "doc", "doc_id", "t", n, features, max_df, 1, sublinear)


@query(f"WITH {_tfidf_sql(_UNI, 0.9, 3000, 'tf')} SELECT doc, term, tf, round(tfidf, 6) AS tfidf FROM w")
def document_tfidf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), G.vector_tokens(F.col("text"), _STOPS).alias("t"))
    w = V.document_tfidf(d, "doc", "t", 1, 2, 3000, max_df=0.9)
    return w.select("doc", "term", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {_tfidf_sql(_POOL, 1.0, 2000, 'tf')}, r AS (SELECT doc, term, round(tfidf, 6) AS tfidf FROM w) SELECT doc, term, tfidf, CAST(row_number() OVER (PARTITION BY doc ORDER BY tfidf DESC, term) AS INTEGER) AS rank FROM r QUALIFY rank <= 15")
def pooled_tfidf_top(spark, sf_dir):
    """Top terms of each entity's joined text."""
    w = _pooled(spark, sf_dir, 2000).select("doc", "term", F.round("tfidf", 6).alias("tfidf"))
    return R.top_per_group(w, ["doc"], F.col("tfidf"), ["term"], 15)


@query(f"WITH {_tfidf_sql(_POOL, 0.95, 5000, '1 + ln(tf)')} SELECT doc, term, tf, round(tfidf, 6) AS tfidf FROM w")
def sublinear_tfidf(spark, sf_dir):
    w = _pooled(spark, sf_dir, 5000, 0.95, sublinear=True)
    return w.select("doc", "term", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {_tfidf_sql(_POOL_TRI, 0.95, 5000, '1 + ln(tf)')} SELECT doc, term, tf, round(tfidf, 6) AS tfidf FROM w")
def sublinear_trigrams(spark, sf_dir):
    w = _pooled(spark, sf_dir, 5000, 0.95, 3, sublinear=True)
    return w.select("doc", "term", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {_tfidf_sql(_POOL, 1.0, 2000, 'tf')}, s AS (SELECT a.doc AS a, b.doc AS b, sum(a.tfidf * b.tfidf) AS s FROM w a JOIN w b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2), i AS (SELECT DISTINCT doc FROM w) SELECT x.doc AS a, y.doc AS b, round(coalesce(s, 0), 3) AS similarity FROM i x JOIN i y ON x.doc < y.doc LEFT JOIN s ON s.a = x.doc AND s.b = y.doc")
def entity_similarity(spark, sf_dir):
    """Cosine similarity of all pairs of entities."""
    return V.cosine_pairs(_pooled(spark, sf_dir, 2000), "doc")
