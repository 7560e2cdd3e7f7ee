"""Queries of the unit operator over test results and data columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import units as U
from lodestone.session import finite, table


def _results(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "stdf_results")
    return r.select(*U.raw_fields(F.col("id"), F.col("units"), F.col("conditions"), F.col("test_txt"), F.col("doc_id"), F.col("test_num"), F.col("result").alias("value"))).where("id IS NOT NULL")


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """Limits of data columns may be in another unit than their values, so they say nothing of the values' size."""
    c = table(spark, sf, "data_columns").where("kind = 'numeric' AND id IS NOT NULL").dropDuplicates(["id"])
    return c.select(*U.raw_fields(F.col("id"), F.col("units"), F.lit(None).cast("string"), F.col("name"), F.lit(None).cast("double").alias("value")))


def _read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(test results, data columns), each row with the columns of READING, null where the common unit holds."""
    results, columns = _results(spark, sf), _columns(spark, sf)
    read, n = U.read_fields(spark, [("test", results), ("column", columns)], table(spark, sf, "unit_targets"))
    codes = read.where("kind = 'test'").select(*U.RAW, "code")
    own = U.attach(results, codes, list(U.RAW), n).drop(*U.RAW)
    # what the row of the smallest id states, for rows that state nothing; a hot (log, test) is split by adaptive execution
    first = own.groupBy("doc_id", "test_num").agg(F.min_by("code", "id").alias("code")).where("code IS NOT NULL")
    silent = own.where("code IS NULL").drop("code").join(first, ["doc_id", "test_num"], "left")
    every = own.where("code IS NOT NULL").unionByName(silent)
    every = U.attach(every.withColumn("code", F.coalesce("code", F.lit(-1))), read.select("code", *U.READING), ["code"], n).drop("code")
    return every, U.attach(columns, read.where("kind = 'column'").select(*U.RAW, *U.READING), list(U.RAW), n)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose unit or scale differs from the common one."""
    results, columns = _read(spark, sf)
    a = results.where(finite(F.col("value")) & U.differs()).select(F.lit("stdf_results").alias("table_name"), F.col("id").alias("row_id"))
    b = columns.where(U.differs()).select(F.lit("data_columns").alias("table_name"), F.col("id").alias("row_id"))
    return a.unionByName(b).distinct()


def p6_results_common(spark: SparkSession, sf: str) -> DataFrame:
    """Every finite test result in the common unit of its quantity; each id once."""
    results, _ = _read(spark, sf)
    r = results.where(finite(F.col("value")))
    return r.select("id", "doc_id", "test_num", "quantity", F.col("value").alias("recorded"), U.to_common(F.col("value")).alias("result")).dropDuplicates(["id"])


def p6_values_common(spark: SparkSession, sf: str) -> DataFrame:
    """The values of numeric data columns in the common unit; each (column, row) once."""
    _, columns = _read(spark, sf)
    v = table(spark, sf, "data_values").select("col_id", "row_idx", "value", "grp").dropDuplicates(["col_id", "row_idx"])
    c = columns.select(F.col("id").alias("col_id"), *U.READING)
    return v.join(c, "col_id").where(finite(F.col("value"))).select("col_id", "row_idx", "quantity", F.col("value").alias("recorded"), U.to_common(F.col("value")).alias("value"), "grp")


def p6_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every unit as stated, of test results and data columns: fields, least and largest factor, those that can't be read with a null quantity."""
    read, _ = U.read_fields(spark, [("test", _results(spark, sf)), ("column", _columns(spark, sf))], table(spark, sf, "unit_targets"))
    return read.groupBy("kind", "unit", "quantity").agg(F.count("*").alias("spellings"), F.min("factor").alias("low"), F.max("factor").alias("high"), F.max("offset").alias("shift"))


QUERIES = {"p6_found": p6_found, "p6_results_common": p6_results_common, "p6_values_common": p6_values_common, "p6_units": p6_units}


def _said(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN ('', '-', 'n/a', 'none') THEN NULL ELSE trim({column}) END"


def _named(column: str) -> str:
    t = rf"regexp_replace({column}, '\[\d+\]$', '')"
    forms = (r"\[([^\]]+)\]$", r"\(([^)]+)\)$", " / (.+)$", " in (.+)$", r"^(?:.*_\d+|Cont_OS)_(\D.*|1/s)$")
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{f}', 1), '')" for f in forms) + ")"


#: Spellings of the common units in the test tables, for the comparison only; the operator parses.
_COMMON = "'v', 'volt', 'volts', 'a', 'amp', 'amps', 'hz', 'hertz', '1/s', 's', 'sec', 'second', 'seconds', 'ohm', 'ohms', 'ω', 'f', 'farad', 'degc', 'deg c', '°c', '℃', 'c', 'celsius', 'w', 'watt', 'watts', '%', 'pct', 'percent'"
SQL = {
    "p6_found": f"""WITH r AS (SELECT id, doc_id, test_num, result, coalesce({_said('units')}, {_said("json_extract_string(conditions, '$.UNITS')")}, {_said(_named('test_txt'))}) AS u FROM stdf_results),
      f AS (SELECT doc_id, test_num, arg_min_null(u, id) AS fu FROM r GROUP BY doc_id, test_num), c AS (SELECT id, coalesce({_said('units')}, {_said(_named('name'))}) AS u FROM data_columns WHERE kind = 'numeric')
      SELECT DISTINCT 'stdf_results' AS table_name, id AS row_id FROM r JOIN f USING (doc_id, test_num) WHERE isfinite(result) AND lower(nfc_normalize(coalesce(u, fu))) NOT IN ({_COMMON})
      UNION SELECT 'data_columns', id FROM c WHERE lower(nfc_normalize(u)) NOT IN ({_COMMON})"""
}
