"""Result tables of the batch pipeline read back, and the manifest."""

import random

from pyspark.sql import functions as F

from tonemill.models import regression as M
from tonemill.plans import pipeline, tables
from tonemill.sources import manifest


def test_tables_are_written(spark, tmp_path):
    rng = random.Random(0)
    folder = tmp_path / "raw"
    folder.mkdir()
    names, years = ["north_macedonia", "albania", "kosovo", "serbia"], [2020, 2021, 2022]
    for name in names:
        for year in years:
            sentence = lambda: " ".join(rng.choices(["the", "minister", "parliament", "report", "court", "economic", "said", "corruption", "remains", "limited", "failed", "adopted"], k=12)).capitalize() + "."
            body = "  \n".join(" ".join(sentence() for _ in range(rng.randint(4, 9))) for _ in range(12))
            (folder / f"{name}_{year}_raw.txt").write_text(body, encoding="utf-8")
    (folder / "montenegro_2020_raw.txt").write_text(body, encoding="utf-8")
    made = pipeline.run(spark, str(folder), str(tmp_path / "out"), 30, 500, form="parquet", results=True, base="North Macedonia")
    back = {n: spark.read.parquet(str(tmp_path / f"out/{n}.parquet")) for n in made}
    terms = [r.term for r in back["spec_b_regression"].collect()]
    found = [c for c in made["scores"].columns if c.startswith("topic_")]
    assert set(terms) == {"Intercept", "Albania", "Kosovo", "Serbia", "year c", *(c.removeprefix("topic_").replace("_", " ") for c in found)}
    assert back["spec_b_regression"].columns == ["term", "hard_flag", "soft_flag", "severity_ratio"]
    alone = M.fit(M.design(tables.regression_input(made["scores"]), "hard_flag", [*found, "year_c"], "country", "North Macedonia", "country"), "logit", "cluster")
    want = dict(zip(alone.names, alone.table(), strict=True))
    got = {r.topic: (r.odds_ratio, r.ci_95) for r in back["topic_odds_ratios"].collect()}
    assert got["economy market"][0].rstrip("*") == f"{want['topic_economy_market'][7]:.3f}" and len(got) == len(found)
    rates = {r.country: r for r in back["hard_flag_probabilities"].collect()}
    assert set(rates) == {"Albania", "Kosovo", "North Macedonia", "Serbia"} and all(abs(r.difference) < 1e-3 for r in rates.values())
    sens = {r.country: r for r in back["sensitivity_preprocessing"].collect()}
    assert set(sens) == {"Albania", "Kosovo", "North Macedonia", "Serbia", "Montenegro"} and sens["Kosovo"].max_300_change == "0.0%"
    weights = back["lda_topic_weights"]
    assert weights.columns == ["country", "year", "chunk", "topic_1", "topic_2", "topic_3"]
    assert weights.where(F.abs(F.col("topic_1") + F.col("topic_2") + F.col("topic_3") - 1) > 1e-6).count() == 0 and weights.count() > 100


def test_manifest_runs_can_be_repeated(spark, tmp_path):
    schema, path = "country string, year int, attempt int, status string", str(tmp_path / "manifest")
    assert manifest.read(spark, path, schema).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    state = lambda: sorted(map(tuple, manifest.read(spark, path, schema).collect()), key=str)
    run = rows(("a", 2020, 1, "missing"), ("a", 2021, 1, "downloaded"), ("b", 2020, 1, "failed"), ("b", 2020, 1, "failed"), (None, 2020, 1, "missing"))
    manifest.merge(run, path, schema, ["country", "year"], "country")
    first = state()
    files = sorted(p.name for p in (tmp_path / "manifest").glob("country=b/*.parquet"))
    assert len(first) == 4
    manifest.merge(run, path, schema, ["country", "year"], "country")
    assert state() == first
    manifest.merge(rows(("a", 2020, 2, "downloaded"), ("a", 2021, 0, "missing")), path, schema, ["country", "year"], "country")
    assert ("a", 2020, 2, "downloaded") in state() and ("a", 2021, 1, "downloaded") in state() and len(state()) == 4
    again = sorted(p.name for p in (tmp_path / "manifest").glob("country=b/*.parquet"))
    manifest.merge(rows(("c", 2020, 1, "missing")).limit(0), path, schema, ["country", "year"], "country")
    assert len(state()) == 4 and files != [] and again == sorted(p.name for p in (tmp_path / "manifest").glob("country=b/*.parquet"))
