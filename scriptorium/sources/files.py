"""File sources and sinks: type detection, JSON documents, JSONL, CSV and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The nested document (unknown keys of a file are dropped when it is read with this schema).
DOCUMENT = """doc_id string, title string, authors array<string>, year int, journal string, doi string, keywords array<string>, abstract string, full_text string,
sections array<struct<name: string, content: string, order: int, level: int, section_type: string, parent_section: string>>,
tables array<struct<caption: string, index: int, headers: array<string>, data: array<array<string>>>>,
figures array<struct<caption: string, index: int, figure_type: string, alt_text: string, keywords: array<string>>>,
formulas array<struct<raw: string, formula_type: string, index: int, display_text: string>>,
references array<struct<raw_text: string, doi: string, title: string, authors: array<string>, year: int>>, source_file string, source_type string, language string, page_count int"""
# File name endings -> type.
EXTENSIONS = {".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".html": "html", ".htm": "html", ".xhtml": "html"}


def file_type(path: Column, content: Column) -> Column:
    """pdf, docx, html or unknown: by the first bytes, else by the ending."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    magic = F.when(head.startswith("%pdf"), "pdf").when(head.startswith("pk\x03\x04") & F.contains(F.decode(content, "ISO-8859-1"), F.lit("word/document.xml")), "docx").when(head.rlike("<!doctype|<html|<head|<body"), "html")
    ending = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    named = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[ending]
    return F.coalesce(magic, named, F.lit("unknown"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", file_type(F.col("path"), F.col("content")).alias("file_type"), "length")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Rerank pairs from JSONL: rows without query or text dropped, numbers defaulted to 0, group to the query."""
    rows = spark.read.schema("query string, text string, label double, base_score double, group_id string").json(path)
    filled = rows.where("trim(coalesce(query, '')) <> '' and trim(coalesce(text, '')) <> ''")
    return filled.select("query", "text", F.coalesce("label", F.lit(0.0)).alias("label"), F.coalesce("base_score", F.lit(0.0)).alias("base_score"), F.coalesce("group_id", "query").alias("group_id"))


def page_text(layer: Column, ocr: Column) -> Column:
    """The text layer if it is nearly as long as the recognised text and not tiny."""
    return F.when((F.length(layer) > 0.8 * F.length(ocr)) & (F.length(layer) > 100), layer).otherwise(ocr)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file below ``path`` whole; bytes that are no UTF-8 are replaced, and empty files give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_documents(docs: DataFrame, path: str, by: list[str]) -> None:
    """Documents as JSON, one folder for each value of the columns ``by`` (user, stem)."""
    docs.repartition(*by).write.partitionBy(*by).mode("overwrite").json(path)


def read_documents_safely(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_documents`, with the text of files that are no JSON in ``broken``; one bad file never ends a job."""
    return spark.read.schema(f"{DOCUMENT}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True)
