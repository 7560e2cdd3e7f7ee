"""Queries over entries, look-ups and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import entries as E
from lodestone.operators import parts as P
from lodestone.plans import files as PF
from lodestone.plans import measure as PM
from lodestone.plans import retrieval as PR
from lodestone.session import table


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stdf_results").dropDuplicates(["id"])


def dataset_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """SNK21, TXT20."""
    return E.summary_chunks(table(spark, sf, "data_columns"), table(spark, sf, "data_values"))


def symbol_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT07."""
    s = E.like_name(PF.code_symbols(spark, sf), "%_DUN%", language="python")
    return s.select("key", "name", E.symbol_text(F.col("kind"), F.col("qualname"), F.col("signature"), F.col("docstring"), F.lit(None).cast("string")).alias("text"))


def column_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT11, FLT19."""
    return E.matching_columns(table(spark, sf, "data_columns").dropDuplicates(["id"]), "*_1*").select("id", "dataset", "name")


def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT09, FLT10: logs by a pattern over path or file name."""
    p = E.fnmatch("*_00[0-9]*.STD*")
    d = table(spark, sf, "documents")
    return d.where(F.col("path").rlike(p) | F.substring_index("path", "/", -1).rlike(p)).select("doc_id", "path")


def hit_images(spark: SparkSession, sf: str) -> DataFrame:
    """JN03, RK11: hits with the pictures of their document and section; picture chunks stand for pictures."""
    i = table(spark, sf, "chunks").where("kind = 'image_ref'").select(F.col("document_id").alias("doc_id"), F.coalesce("locator", F.lit("")).alias("locator"), F.sha2("text", 256).alias("sha256"))
    c = table(spark, sf, "chunks").dropDuplicates(["id"]).where("kind = 'body'").select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id"), F.coalesce("locator", F.lit("")).alias("locator"))
    return E.with_images(c, i).select("chunk_id", F.size("images").cast("bigint").alias("images"))


def image_staging(spark: SparkSession, sf: str) -> DataFrame:
    """SNK09, SNK23, TK11."""
    i = table(spark, sf, "chunks").where("kind = 'image_ref'").select(F.col("document_id").alias("doc_id"), "locator", F.col("text").cast("binary").alias("content"), F.lit("").alias("alt"), F.lit(None).cast("string").alias("caption"), F.lit("x.png").alias("src"))
    return E.stage_images(i)[0].select("sha256", "doc_id", "uses")


def site_groups(spark: SparkSession, sf: str) -> DataFrame:
    """AG14, AU11, AU16."""
    g = E.site_groups(PM.measurements(spark, sf), ["test", "site"])
    return g.select("test", "site", "n", "low", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"), F.round("q3", 4).alias("q3"), "high")


def value_sample(spark: SparkSession, sf: str) -> DataFrame:
    """TK09: a plot's first values of each test (the cap is the operator)."""
    return E.value_sample(PM.measurements(spark, sf), ["test"], E.PLOT_VALUES).select("test", "id", "result")


def qq_points(spark: SparkSession, sf: str) -> DataFrame:
    """AU16."""
    return E.qq_points(PM.measurements(spark, sf), ["test"])


def document_maps(spark: SparkSession, sf: str) -> DataFrame:
    """MS01-MS05, SRC36: chunk, document, source and hash."""
    c = table(spark, sf, "chunks").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id"), "ord")
    return c.join(table(spark, sf, "documents").select("doc_id", "source", "path", "content_hash"), "doc_id", "left")


def selector_proposal(spark: SparkSession, sf: str) -> DataFrame:
    """TXT25."""
    return E.propose_selectors(table(spark, sf, "raw_pages"))


def log_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """SNK19."""
    return E.test_chunks(_results(spark, sf), P.touchdowns(table(spark, sf, "stdf_parts")))


def condition_flags(spark: SparkSession, sf: str) -> DataFrame:
    """SNK19, SNK03."""
    return E.condition_flags(_results(spark, sf))


def lenient_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """FN01-FN04 over part ids."""
    r = _results(spark, sf).select("part_id").distinct()
    return r.select("part_id", E.as_int(F.col("part_id")).alias("number"), F.size(E.as_list(F.col("part_id"))).cast("bigint").alias("listed"), E.plain(F.col("part_id").cast("binary")).alias("hex"))


_SITE = PM._M
QUERIES = {f.__name__: f for f in (dataset_summaries, symbol_filter, column_filter, log_filter, hit_images, image_staging, site_groups, value_sample, qq_points, document_maps, selector_proposal, log_chunks, condition_flags, lenient_numbers)}
SQL = {
    "dataset_summaries": """WITH n AS (SELECT col_id, count(*) AS v FROM (SELECT DISTINCT ON (col_id, row_idx) * FROM data_values) GROUP BY col_id), c AS (SELECT DISTINCT ON (id) * FROM data_columns)
      SELECT doc_id, dataset, 'Dataset ' || dataset || ': ' || string_agg(name || ' (' || kind || CASE WHEN kind = 'numeric' THEN ', ' || coalesce(v, 0) ELSE '' END || ')', ', ' ORDER BY id) AS text FROM c LEFT JOIN n ON n.col_id = c.id GROUP BY doc_id, dataset""",
    "column_filter": "SELECT DISTINCT id, dataset, name FROM data_columns WHERE kind = 'numeric' AND (contains(name, '_1') OR contains(dataset || '.' || name, '_1'))",
    "log_filter": "SELECT doc_id, path FROM documents WHERE regexp_matches(lower(path), '_00[0-9].*\\.std.*$')",
    "hit_images": """WITH i AS (SELECT DISTINCT document_id, coalesce(locator, '') AS l, sha256(text) AS s FROM chunks WHERE kind = 'image_ref'), n AS (SELECT document_id, l, count(*) AS n FROM i GROUP BY ALL), c AS (SELECT DISTINCT ON (id) * FROM chunks)
      SELECT id AS chunk_id, coalesce(n, 0) AS images FROM c LEFT JOIN n ON n.document_id = c.document_id AND n.l = coalesce(c.locator, '') WHERE kind = 'body'""",
    "image_staging": "SELECT sha256(text) AS sha256, min(document_id) AS doc_id, count(*) AS uses FROM chunks WHERE kind = 'image_ref' AND text IS NOT NULL GROUP BY 1",
    "site_groups": f"WITH {_SITE} SELECT test, site, count(*) AS n, min(result) AS low, round(quantile_cont(result, 0.25), 4) AS q1, round(quantile_cont(result, 0.5), 4) AS median, round(quantile_cont(result, 0.75), 4) AS q3, max(result) AS high FROM m GROUP BY test, site",
    "value_sample": f"WITH {_SITE} SELECT test, id, result FROM m QUALIFY row_number() OVER (PARTITION BY test ORDER BY id) <= 20000",
    "qq_points": f"WITH {_SITE}, g AS (SELECT test, quantile_cont(result, list_transform(range(21), lambda i: i / 20.0)) FILTER (run = 'A') AS a, quantile_cont(result, list_transform(range(21), lambda i: i / 20.0)) FILTER (run = 'B') AS b FROM m GROUP BY test) SELECT test, CAST(generate_subscripts(a, 1) - 1 AS INT) AS i, round(unnest(a), 4) AS x, round(unnest(b), 4) AS y FROM g WHERE a IS NOT NULL AND b IS NOT NULL",
    "document_maps": "WITH c AS (SELECT DISTINCT ON (id) * FROM chunks) SELECT id AS chunk_id, document_id AS doc_id, ord, source, path, content_hash FROM c LEFT JOIN documents ON doc_id = document_id",
    "condition_flags": "WITH r AS (SELECT DISTINCT doc_id, conditions FROM stdf_results WHERE conditions IS NOT NULL) SELECT DISTINCT doc_id, 'condition' AS kind, k || '=' || json_extract_string(conditions, '$.\"' || k || '\"') AS note FROM (SELECT *, unnest(json_keys(conditions)) AS k FROM r)",
}
