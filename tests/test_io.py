"""Sources, sinks, the batch pipeline and its stream."""

from tonemill import lexicons as L
from tonemill import schemas
from tonemill.plans import pipeline
from tonemill.sources import readers, sinks
from tonemill.streaming import scores as stream


def reports(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    body = "  \n".join(" ".join(["the court failed to act on serious concern"] * 8) for _ in range(3))
    (folder / "north_macedonia_2024_raw.txt").write_text(f"===== PAGE 1 =====\n{body}", encoding="utf-8")
    (folder / "kosovo_2023_raw.txt").write_text(body, encoding="utf-8")
    (folder / "other.txt").write_text("no report", encoding="utf-8")
    (folder / "kosovo_2023_corpus.txt").write_text("one two\n* * *\nthree", encoding="utf-8")
    return str(folder)


def test_readers(spark, tmp_path):
    folder = reports(tmp_path)
    assert {(r["country"], r["year"]) for r in readers.raw_reports(spark, folder).collect()} == {("North Macedonia", 2024), ("Kosovo", 2023)}
    assert [(r["section"], r["word_count"]) for r in readers.section_reports(spark, folder).orderBy("section").collect()] == [("1.1_Context", 2), ("1.2_Summary", 1)]
    assert readers.file_listing(spark, folder).count() == 4


def test_pipeline_and_round_trip(spark, tmp_path):
    made = pipeline.run(spark, reports(tmp_path), str(tmp_path / "out"), form="csv")
    assert made["scores"].count() == 6
    back = readers.csv_table(spark, str(tmp_path / "out/summary.csv"), schemas.SUMMARY).collect()
    assert {(r["country"], r["year"], r["criticism_hard_p1k"]) for r in back} == {("Kosovo", 2023, 125.0), ("North Macedonia", 2024, 125.0)}
    sinks.write_text(made["scores"].select("country", "year", "paragraph_text"), str(tmp_path / "text"), "paragraph_text")
    assert spark.read.text(str(tmp_path / "text")).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    folder = reports(tmp_path)
    q = stream.start_summary(stream.score_stream(stream.paragraph_stream(spark, folder), L.CRITICISM_HARD, L.CRITICISM_SOFT), "summary", str(tmp_path / "state"))
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("summary").collect()}
    finally:
        q.stop()
    assert {r[:3] for r in got} == {("Kosovo", 2023, 125.0), ("North Macedonia", 2024, 125.0)}


def test_bad_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "x_2020_raw.txt").write_bytes(b"caf\xc3\xa9 \xff\xc3 end")
    (tmp_path / "y_2020_raw.txt").write_text("kept �", encoding="utf-8")
    assert sorted(r["text"] for r in readers.text_files(spark, str(tmp_path)).collect()) == ["café  end", "kept �"]
