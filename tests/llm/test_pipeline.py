"""The corpus pipeline: each stage against brute force, edge rows and empty tables."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import roots, shingles
from test_packing import check
from test_scores import brute_leaks

from tonemill.llm import quality


def test_every_stage_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if k == 0:
            want = good
        elif k == 1:
            first = {}
            for d in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d] or ""), d)
            want = set(first.values())
        elif k == 2:
            least = roots({d: shingles(t) for d, t in rows.items()})
            want = {d for d in rows if least[d] == d}
        else:
            want = set(rows) - {d for d, _ in brute_leaks(rows.items(), benchmark)}
        assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want), name
        assert k in (2,) or len(want) < len(rows)
    check(docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize(("k", "gone"), [(1, [2, 5, None, 14]), (2, [2, 3, 10, None]), (3, [])])
def test_stages_on_edge_rows(spark, edge_docs, sf, k, gone):
    """Null, empty, very long and repeated texts, null ids and columns whose names clash."""
    out = corpus_pipeline.STAGES[k][1](spark, edge_docs, sf)
    assert out.schema == edge_docs.schema
    want = [r["doc_id"] for r in edge_docs.collect()]
    for d in gone:
        want.remove(d)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, want))
    rows = {str(r) for r in edge_docs.collect()}
    assert all(str(r) in rows for r in out.collect())


def test_quality_and_packing_on_edge_rows(spark, edge_docs, sf):
    out = corpus_pipeline.STAGES[0][1](spark, edge_docs, sf)
    assert out.schema == edge_docs.schema and out.count() <= edge_docs.count()
    check(edge_docs, corpus_pipeline.STAGES[4][1](spark, edge_docs, sf).collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_an_empty_table(spark, no_docs, sf, k):
    out = corpus_pipeline.STAGES[k][1](spark, no_docs, sf)
    assert out.count() == 0
    assert k == 4 or out.schema == no_docs.schema


def test_rows_of_one_id(spark, sf):
    """An id's other text stays when one of its texts goes, and null ids are judged by their texts."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (None, a + " z"), (None, "other words"), (None, "other  words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    exact = corpus_pipeline.exact_dedup_stage(spark, docs, sf)
    assert sorted(((r["doc_id"], r["text"][:5]) for r in exact.collect()), key=str) == sorted([(1, a[:5]), (2, b[:5]), (None, a[:5]), (None, "other")], key=str)
    near = corpus_pipeline.near_dedup_stage(spark, exact, sf)
    assert sorted(((r["doc_id"], r["text"][:5]) for r in near.collect()), key=str) == sorted([(1, a[:5]), (2, b[:5]), (None, "other")], key=str)
