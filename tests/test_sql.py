"""SQL functions give what the DataFrame operators give."""

import pytest
from pyspark.sql import functions as F

from tonemill import sql
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.operators import segment as G

TERMS = ["the", "of the", "aa", "é"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    sql.register(spark)
    long = "One two three. " * 300
    rows = [(9001, "===== PAGE 1 =====\nAbcd efgh. \nNext page's text\n===== PAGE 22 ===== \n\n==== PAGE 3 ====\n" + long), (9002, None), (9003, ""), (9004, "He met Mr. \nSmith, e.g. There. Then  \nit ended. \n→ Arrow here"), (9005, "aaaa é THE of the")]
    d = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", F.replace("text", F.lit("\n"), F.lit("  \n")).alias("text"))
    d = d.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    d.createOrReplaceTempView("texts")
    return d


def same(a, b):
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0


def test_scalar_functions(spark, docs):
    terms = "array(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
    got = spark.sql(f"SELECT doc_id, word_count(text) AS n, raw_count(text, {terms}) AS raw, dict_score(text, {terms}) AS score, severity(raw_count(text, array('the')), raw_count(text, array('of'))) AS ratio FROM texts")
    t = F.col("text")
    ratio = S.severity(S.raw_count(t, ["the"]).cast("double"), S.raw_count(t, ["of"]).cast("double"))
    same(got, docs.select("doc_id", X.word_count(t).alias("n"), S.raw_count(t, TERMS).alias("raw"), S.dict_score(t, TERMS).alias("score"), ratio.alias("ratio")))


@pytest.mark.parametrize(("low", "high"), [(50, 500), (3, 40)])
def test_build_corpus(spark, docs, low, high):
    got = spark.sql(f"SELECT d.doc_id, p.* FROM texts d, LATERAL build_corpus(d.text, {low}, {high}) p")
    same(got, G.build_corpus(docs, "text", low, high))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_load_chunks(spark, docs):
    same(spark.sql("SELECT d.doc_id, p.* FROM texts d, LATERAL load_chunks(d.text) p"), G.page_chunks(docs))


def test_sentences(spark, docs):
    got = spark.sql("SELECT d.doc_id, s.* FROM texts d, LATERAL segment_by_sentences(d.text, 25) s")
    same(got, docs.select("doc_id", F.posexplode(G.sentences(F.col("text"))).alias("position", "sentence")))
