"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import decontamination, exact_dedup, hard_negatives, importance, language, license_scan, ngram_jaccard, packing, quality, substring_dedup, suffix_tree, token_counts, url_filters
from tonemill.llm.common import crc_mod, table


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return url_filters.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles, number of links to other documents and component."""
    return ngram_jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and a digest of the kept ones."""
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it leaks."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pre-tokens and tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the suffix tree of the training share."""
    out = suffix_tree.learn_and_score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight, score and place in the draw towards the benchmark's distribution."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of one row in a hundred, by labels of which one in seven is moved."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_RULES_SQL = """
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))"""
OP4_SQL = rf"""
WITH RECURSIVE {_RULES_SQL},
urls AS (
  SELECT page_id, url, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
judged AS (
  SELECT u.page_id, u.url, u.host, u.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS own
  FROM urls u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
),
links AS (
  SELECT url AS s, unnest([
    regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
  FROM urls
),
edges AS (SELECT s, t FROM links WHERE contains(t, '://') AND s <> t UNION SELECT t, s FROM links WHERE contains(t, '://') AND s <> t),
blocked(u) AS (
  SELECT url FROM judged WHERE own = 'block'
  UNION
  SELECT e.t FROM blocked b JOIN edges e ON e.s = b.u
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN url IN (SELECT u FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

OP12_SQL = r"""
WITH step0 AS (SELECT range(256)::BIGINT[] AS t),
crc_table AS (SELECT list_transform(t, lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t FROM step0),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
lists AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS l FROM texts),
words AS (SELECT side, id, unnest(l) AS w FROM lists),
bytes AS (SELECT w, list_transform(range(0, length(hex(encode(w))), 2), lambda i: ('0x' || hex(encode(w))[i + 1:i + 2])::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
codes AS (SELECT w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
totals AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN codes USING (w) GROUP BY bucket),
sizes AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain FROM totals, sizes),
weights AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN codes USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scores WHERE n_features >= 20)
SELECT s.*, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM scores s LEFT JOIN placed USING (doc_id)
"""

OP13_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_packing, op3_exact_dedup, op4_url_filters, op5_substring_dedup, op6_decontamination, op7_token_counts, op8_language, op9_license_scan, op10_ngram_jaccard, op11_lm_scoring, op12_importance, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_url_filters": OP4_SQL, "op9_license_scan": license_scan.oracle_sql(), "op12_importance": OP12_SQL, "op13_hard_negatives": OP13_SQL}
