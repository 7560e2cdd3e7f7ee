"""Queries whose input is files or parsed text: pages, code, binary logs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import corpus as K
from lodestone.sources import code, documents
from lodestone.session import table
from lodestone.streaming.ingest import event_yield


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    """SRC05-SRC10: segments of every raw page."""
    pages = table(spark, sf, "raw_pages").select(F.concat(F.col("document_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return documents.extract_all(pages).select("path", "title", F.explode("segments").alias("s")).select("path", "title", "s.*")


def html_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """SNK22: pages to chunks: extraction, then packing."""
    s = html_extract(spark, sf).withColumn("document_id", F.substring_index("path", ".", 1).cast("bigint"))
    return K.word_chunks(s.select("document_id", "ord", "kind", "heading_path", "text"))


def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """SRC31, SRC33, SNK20: symbols of all code chunks by their document's language, or by what the text looks like."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), code.language(F.col("path")).alias("language"))
    c = table(spark, sf, "chunks").where("kind IN ('code', 'function')").dropDuplicates(["id"]).join(d, "document_id", "left")
    guess = F.when(F.col("text").rlike(r"(?m)^(def|class) .*:$"), "python").when(F.col("text").rlike(r"(?mi)^\s*end (sub|function)\b"), "vba").otherwise("c")
    return code.parse_symbols(c.select(F.col("id").alias("key"), F.coalesce("language", guess).alias("language"), "text"))


def style_guide(spark: SparkSession, sf: str) -> DataFrame:
    """AG28, AG29."""
    return code.style(code_symbols(spark, sf))


def repo_scan(spark: SparkSession, sf: str) -> DataFrame:
    """SRC37: files by class and suffix, out of the catalog's paths."""
    d = table(spark, sf, "documents").select(F.lower(F.substring_index("path", ".", -1)).alias("ext"))
    kind = F.when(F.col("ext").isin(*code.LANGUAGES), "code").when(F.col("ext").isin("csv", "tsv", "std", "stdf", "xlsx"), "data").otherwise("doc")
    return d.groupBy(kind.alias("category"), "ext").agg(F.count("*").alias("n"))


def store_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    """SRC38 over the counts of ``repo_scan``."""
    return K.store_type(repo_scan(spark, sf))


def glob_classes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC01-SRC03 over the catalog's paths."""
    return documents.classified(table(spark, sf, "documents").select("doc_id", "path"), ["**/*.html", "app-notes/**"], ["bench-*/**"]).select("doc_id", "class")


def event_stream_yield(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed yield of the event table, by the code that runs on a stream."""
    return event_yield(table(spark, sf, "events"))


QUERIES = {f.__name__: f for f in (html_extract, html_chunks, code_symbols, style_guide, repo_scan, store_recommendation, glob_classes, event_stream_yield)}
SQL = {
    "repo_scan": "WITH d AS (SELECT lower(string_split(path, '.')[-1]) AS ext FROM documents) SELECT CASE WHEN ext IN (" + ", ".join(f"'{x}'" for x in code.LANGUAGES) + ") THEN 'code' WHEN ext IN ('csv', 'tsv', 'std', 'stdf', 'xlsx') THEN 'data' ELSE 'doc' END AS category, ext, count(*) AS n FROM d GROUP BY 1, 2",
    "store_recommendation": "WITH d AS (SELECT lower(string_split(path, '.')[-1]) AS ext FROM documents), k AS (SELECT CASE WHEN ext IN (" + ", ".join(f"'{x}'" for x in code.LANGUAGES) + ") THEN 'code' WHEN ext IN ('csv', 'tsv', 'std', 'stdf', 'xlsx') THEN 'data' ELSE 'doc' END AS category FROM d), g AS (SELECT count(*) FILTER (category = 'code') AS code, count(*) FILTER (category = 'data') AS data, count(*) FILTER (category = 'doc') AS doc FROM k) SELECT *, CASE WHEN code > 0 AND code >= data AND code > doc THEN 'code' WHEN data > 0 AND data > doc THEN 'data' ELSE 'document' END AS store_type FROM g",
    "glob_classes": "SELECT doc_id, CASE WHEN regexp_matches(path, '^bench-[^/]*/.*$') THEN 'excluded' WHEN regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.html$') OR starts_with(path, 'app-notes/') THEN 'included' ELSE 'other' END AS class FROM documents",
    "event_stream_yield": "SELECT date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (event_type <> 'error') AS good FROM events GROUP BY 1",
}
