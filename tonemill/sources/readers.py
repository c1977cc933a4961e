"""Sources: whole-file text with keys in the file name, CSV with a stated schema, Parquet, fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.operators import segment


def text_files(spark: SparkSession, folder: str, pattern: str = "*_raw.txt") -> DataFrame:
    """path, name, text: a row per file. Bytes that are no UTF-8 are dropped (and with them, in such a file, replacement characters)."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))).alias("text"))


def raw_reports(spark: SparkSession, folder: str, pattern: str = "*_raw.txt") -> DataFrame:
    """country, year, text of files named <slug>_<year>_raw.txt; other names are skipped."""
    country, year = segment.parse_filename(F.col("name"))
    return text_files(spark, folder, pattern).select(country.alias("country"), year.alias("year"), "text").where("country is not null")


def section_reports(spark: SparkSession, folder: str, pattern: str = "*_corpus.txt") -> DataFrame:
    """country (slug), year (text), section, section_text, word_count of section files."""
    slug, year = segment.parse_tokens(F.col("name"))
    files = text_files(spark, folder, pattern).select(slug.alias("country"), year.alias("year"), "text").where("year is not null")
    return segment.explode_sections(files, segment.star_sections(F.col("text")))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, quoted fields over several lines, and a stated schema."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size, changed: files of a folder, without their content."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def accepted_download(content_type, disposition, url):
    """Whether a response is a document: by type, by attachment name, or by the url's ending."""
    return F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(disposition).contains(".pdf"), F.lit(False)) | F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))
