"""Queries over touchdowns, test results and raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import conditions as C
from lodestone.operators import parts as P
from lodestone.session import finite, table

INSERTIONS = ["wafer sort", "ft1", "ft2", "qa"]
KEY = ["lot", "part_id"]
SPLIT = "2024-07-01"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return P.touchdowns(table(spark, sf, "stdf_parts"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stdf_results").dropDuplicates(["id"])


def part_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.part_summary(_parts(spark, sf))


def part_yield(spark: SparkSession, sf: str) -> DataFrame:
    return P.part_yield(_results(spark, sf))


def insertion_yield(spark: SparkSession, sf: str) -> DataFrame:
    return P.insertion_yield(_parts(spark, sf), KEY)


def trace_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return P.trace_matrix(_parts(spark, sf), KEY, INSERTIONS)


def wafer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return P.wafer_rollup(_parts(spark, sf), ["doc_id", "wafer"])


def mother_lot(spark: SparkSession, sf: str) -> DataFrame:
    return P.mother_lot(_parts(spark, sf))


def production_trend(spark: SparkSession, sf: str) -> DataFrame:
    return P.production_trend(_parts(spark, sf))


def die_grid(spark: SparkSession, sf: str) -> DataFrame:
    return P.die_grid(_parts(spark, sf), ["doc_id", "wafer"])


def parametric_map(spark: SparkSession, sf: str) -> DataFrame:
    v = _results(spark, sf).where((F.col("test_num") == 1000) & finite(F.col("result"))).select("doc_id", "part_id", "id", "result")
    return P.parametric_map(_parts(spark, sf), v, ["doc_id", "wafer"]).withColumn("color", P.heat(F.col("t")))


def record_types(spark: SparkSession, sf: str) -> DataFrame:
    """AG11."""
    return _results(spark, sf).groupBy("doc_id", "rec_type").agg(F.count("*").alias("n"))


def test_list(spark: SparkSession, sf: str) -> DataFrame:
    """AG12, AG13."""
    return _results(spark, sf).groupBy("test_num").agg(F.max("test_txt").alias("test_txt"), F.max("rec_type").alias("rec_type"), F.count("*").alias("n"), F.count("result").alias("with_result"))


def stdf_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """AG32, JN14: each log with its counts, first lot, insertions in order."""
    r = table(spark, sf, "stdf_results").groupBy("doc_id").agg(F.count_distinct("id").alias("n_results"))
    p = _parts(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.min_by("lot", "id").alias("lot"), F.array_join(F.sort_array(F.collect_set("insertion")), ",").alias("insertions"))
    d = table(spark, sf, "documents").select("doc_id", "path")
    return d.join(r, "doc_id").join(p, "doc_id", "left").select("doc_id", "path", "n_results", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), "lot", "insertions")


def filtered_results(spark: SparkSession, sf: str) -> DataFrame:
    """FLT06: a test's results of one insertion, in order."""
    r = _results(spark, sf).where("test_num = 1000 AND lower(insertion) = 'ft1'")
    return r.select("id", "doc_id", "site", "result", "passed").orderBy("id")


def run_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """AU10, MS11: each log's header with the span of its results."""
    r = _results(spark, sf).groupBy("doc_id").agg(F.min("tested_at").alias("start"), F.max("tested_at").alias("finish"), F.count_distinct("test_num").alias("tests"), F.count_distinct("part_id").alias("parts"))
    return r.join(table(spark, sf, "documents").select("doc_id", "title"), "doc_id", "left")


def condition_diff(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf).withColumn("run", F.when(F.col("tested_at") < SPLIT, "A").otherwise("B"))
    return C.condition_diff(C.condition_sets(r, ["run"]), "run", "A", "B")


def test_time_lines(spark: SparkSession, sf: str) -> DataFrame:
    """AU09: mean test time before and after, all touchdowns and bin 1; zero times don't count."""
    first = table(spark, sf, "stdf_results").groupBy("doc_id").agg(F.min("tested_at").alias("at"))
    p = _parts(spark, sf).join(first, "doc_id").withColumn("run", F.when(F.col("at") < SPLIT, "A").otherwise("B")).where("test_time_ms > 0")
    return p.groupBy("run").agg(F.round(F.avg("test_time_ms"), 4).alias("mean_ms"), F.round(F.avg(F.when(F.col("hard_bin") == 1, F.col("test_time_ms"))), 4).alias("mean_ms_bin1"), F.count("*").alias("n"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A raw record stream out of events, in order, a run for each user: purchases set, errors clear, signups end a part, the rest are tests. Some texts
    match no rule (``COND x=1`` lacks the colon) or clear a key that nothing sets (``COND_OFF A,B`` names one)."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "DTR").when(F.col("event_type") == "signup", "PRR").otherwise("PTR")
    text = F.when(F.col("event_type") == "purchase", F.concat(F.lit("COND: C"), F.pmod(k, F.lit(5)).cast("string"), F.lit("="), k.cast("string"))).when(F.col("event_type") == "error", F.when(F.pmod(k, F.lit(4)) == 0, "COND_OFF: *").otherwise(F.concat(F.lit("COND_OFF: C"), F.pmod(k, F.lit(5)).cast("string"))))
    text = F.when((F.col("event_type") == "purchase") & (F.pmod(k, F.lit(6)) == 1), F.concat(F.lit("COND C1="), k.cast("string"))).when((F.col("event_type") == "error") & (F.pmod(k, F.lit(8)) == 1), "COND_OFF C1,C2").otherwise(text)
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), kind.alias("rec_type"), text.alias("text"), F.pmod(k, F.lit(7)).alias("test_num"), k.alias("k"), F.col("value"))


def sticky_conditions(spark: SparkSession, sf: str) -> DataFrame:
    s = C.sticky_conditions(_records(spark, sf))
    return s.select("run", "ord", F.array_join(F.transform(F.map_entries("cond"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("cond"))


def static_inherit(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    t = _records(spark, sf).where("rec_type = 'PTR'").select(
        "run", "ord", "test_num", F.when(F.pmod(k, F.lit(3)) == 0, "").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("test_txt"), F.lit("V").alias("units"), F.when(F.pmod(k, F.lit(2)) == 0, F.col("value")).alias("lo"), F.col("value").alias("hi"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 16, 32, 64, 128))), (F.pmod(k, F.lit(5)) + 1).cast("int"))).alias("opt_flag"),
    )
    return C.inherit_static(t)


_P = "p AS (SELECT DISTINCT ON (id) * REPLACE (regexp_replace(lower(trim(coalesce(insertion, ''))), '[\\s_-]+', ' ', 'g') AS insertion) FROM stdf_parts)"
_R = "r AS (SELECT DISTINCT ON (id) * FROM stdf_results)"
_KEY = "CASE WHEN trim(coalesce(lot, '')) = '' AND trim(coalesce(part_id, '')) = '' THEN coalesce(part_id, '') ELSE trim(coalesce(lot, '')) || '|' || trim(coalesce(part_id, '')) END"
_W = "w AS (SELECT lot, wafer, count(*) AS dies, CAST(sum(passed) AS BIGINT) AS passed, round(sum(passed) / count(*), 6) AS yield FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND trim(coalesce(wafer, '')) <> '' GROUP BY lot, wafer)"
_E = """x AS (SELECT user_id AS run, event_id AS ord, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_type IN ('purchase', 'error') THEN 'DTR' WHEN event_type = 'signup' THEN 'PRR' ELSE 'PTR' END AS rec_type, event_type FROM events)"""

QUERIES = {f.__name__: f for f in (part_summary, part_yield, insertion_yield, trace_matrix, wafer_rollup, mother_lot, production_trend, die_grid, parametric_map, record_types, test_list, stdf_catalog, filtered_results, run_rebuild, condition_diff, test_time_lines, sticky_conditions, static_inherit)}
SQL = {
    "part_summary": f"WITH {_P} SELECT doc_id, count(*) AS parts, count(*) FILTER (hard_bin = 1) AS bin1, round(avg(test_time_ms) FILTER (test_time_ms > 0), 4) AS mean_ms, round(avg(test_time_ms) FILTER (test_time_ms > 0 AND hard_bin = 1), 4) AS mean_ms_bin1 FROM p GROUP BY doc_id",
    "part_yield": f"WITH {_R}, q AS (SELECT doc_id, part_id, min(passed) AS ok FROM r WHERE trim(coalesce(part_id, '')) <> '' GROUP BY doc_id, part_id) SELECT doc_id, count(*) AS parts, count(*) FILTER (ok = 1) AS good, round(avg(CASE WHEN ok = 1 THEN 1.0 ELSE 0.0 END), 6) AS yield FROM q GROUP BY doc_id",
    "insertion_yield": f"""WITH {_P}, u AS (SELECT insertion, {_KEY} AS key, min_by(passed, id) AS f, max_by(passed, id) AS l, count(*) AS n, min(id) AS seen FROM p GROUP BY ALL)
      SELECT insertion, row_number() OVER (ORDER BY min(seen)) AS place, count(*) AS units, CAST(sum(f) AS BIGINT) AS first_pass, CAST(sum(l) AS BIGINT) AS final_pass, count(*) FILTER (n > 1) AS retested, round(sum(f) / count(*), 6) AS first_yield, round(sum(l) / count(*), 6) AS final_yield FROM u GROUP BY insertion""",
    "trace_matrix": f"""WITH {_P}, u AS (SELECT {_KEY} AS key, insertion, max_by(passed, id) AS v FROM p GROUP BY ALL) SELECT key, max(v) FILTER (insertion = 'wafer sort') AS wafer_sort, max(v) FILTER (insertion = 'ft1') AS ft1, max(v) FILTER (insertion = 'ft2') AS ft2, max(v) FILTER (insertion = 'qa') AS qa FROM u GROUP BY key""",
    "wafer_rollup": f"WITH {_P} SELECT doc_id, wafer, count(*) AS dies, CAST(sum(passed) AS BIGINT) AS passed, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, round(sum(passed) / count(*), 6) AS yield FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY doc_id, wafer",
    "mother_lot": f"WITH {_P}, {_W} SELECT lot, count(*) AS wafers, CAST(sum(dies) AS BIGINT) AS dies, CAST(sum(passed) AS BIGINT) AS passed, round(sum(passed) / sum(dies), 6) AS yield, first(wafer ORDER BY yield, wafer) AS worst_wafer, min(yield) AS worst_yield FROM w GROUP BY lot",
    "production_trend": f"WITH {_P}, g AS (SELECT doc_id, arg_min_null(lot, id) AS lot, count(*) AS dies, CAST(sum(passed) AS BIGINT) AS passed FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY doc_id) SELECT doc_id, coalesce(lot, 'doc ' || doc_id) AS label, dies, passed, round(passed / dies, 6) AS yield FROM g",
    "die_grid": f"""WITH {_P}, d AS (SELECT doc_id, wafer, x, y, max_by({{'s': soft_bin, 'p': passed}}, id) AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), g AS (SELECT *, min(x) OVER w AS x0, min(y) OVER w AS y0, greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w) AS span FROM d WINDOW w AS (PARTITION BY doc_id, wafer))
      SELECT doc_id, wafer, x - x0 + 1 AS col, y - y0 + 1 AS row, d.s AS soft_bin, CAST(dense_rank() OVER (PARTITION BY doc_id, wafer ORDER BY d.s NULLS FIRST) - 1 AS INT) AS color, d.p AS passed FROM g WHERE span < 1024""",
    "parametric_map": f"""WITH {_P}, {_R}, pos AS (SELECT doc_id, part_id, wafer, max_by({{'x': x, 'y': y}}, id) AS p FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND trim(coalesce(part_id, '')) <> '' GROUP BY ALL), v AS (SELECT doc_id, part_id, max_by(result, id) AS v FROM r WHERE test_num = 1000 AND isfinite(result) GROUP BY ALL),
      j AS (SELECT doc_id, wafer, part_id, pos.p.x AS x, pos.p.y AS y, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM pos JOIN v USING (doc_id, part_id) WINDOW w AS (PARTITION BY doc_id, wafer)), k AS (SELECT doc_id, wafer, part_id, x, y, round(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (v - lo) / (hi - lo))) ELSE 0.5 END, 6) AS t FROM j),
      h AS (SELECT *, CASE WHEN t < 0.5 THEN t * 2 ELSE 1.0 END AS up, CASE WHEN t > 0.5 THEN (1 - t) * 2 ELSE 1.0 END AS down FROM k)
      SELECT doc_id, wafer, part_id, x, y, t, printf('#%02x%02x%02x', CAST(round(up * 255) AS INT), CAST(round(least(up, down) * 255) AS INT), CAST(round(down * 255) AS INT)) AS color FROM h""",
    "record_types": f"WITH {_R} SELECT doc_id, rec_type, count(*) AS n FROM r GROUP BY ALL",
    "test_list": f"WITH {_R} SELECT test_num, max(test_txt) AS test_txt, max(rec_type) AS rec_type, count(*) AS n, count(result) AS with_result FROM r GROUP BY test_num",
    "stdf_catalog": f"""WITH {_P}, a AS (SELECT doc_id, count(DISTINCT id) AS n_results FROM stdf_results GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS n_parts, arg_min_null(lot, id) AS lot, array_to_string(list_sort(list(DISTINCT insertion)), ',') AS insertions FROM p GROUP BY doc_id)
      SELECT doc_id, path, n_results, coalesce(n_parts, 0) AS n_parts, lot, insertions FROM documents JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "filtered_results": f"WITH {_R} SELECT id, doc_id, site, result, passed FROM r WHERE test_num = 1000 AND lower(insertion) = 'ft1'",
    "run_rebuild": f"WITH {_R}, g AS (SELECT doc_id, min(tested_at) AS start, max(tested_at) AS finish, count(DISTINCT test_num) AS tests, count(DISTINCT part_id) AS parts FROM r GROUP BY doc_id) SELECT doc_id, start, finish, tests, parts, title FROM g LEFT JOIN documents USING (doc_id)",
    "condition_diff": f"""WITH {_R}, s AS (SELECT DISTINCT CASE WHEN tested_at < TIMESTAMP '{SPLIT}' THEN 'A' ELSE 'B' END AS run, k, json_extract_string(conditions, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(conditions)) AS k FROM r WHERE conditions IS NOT NULL))
      SELECT k, v, min(run) AS only_in FROM s GROUP BY k, v HAVING count(*) = 1""",
    "test_time_lines": f"""WITH {_P}, f AS (SELECT doc_id, min(tested_at) AS began FROM stdf_results GROUP BY doc_id) SELECT CASE WHEN began < TIMESTAMP '{SPLIT}' THEN 'A' ELSE 'B' END AS run, round(avg(test_time_ms), 4) AS mean_ms, round(avg(test_time_ms) FILTER (hard_bin = 1), 4) AS mean_ms_bin1, count(*) AS n FROM p JOIN f USING (doc_id) WHERE test_time_ms > 0 GROUP BY 1""",
    "sticky_conditions": f"""WITH {_E}, e AS (SELECT *, sum(CASE WHEN rec_type = 'PRR' OR (event_type = 'error' AND k % 4 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ord) AS epoch FROM x),
      v AS (SELECT run, ord, epoch, 'C' || (k % 5) AS c, CASE WHEN event_type = 'purchase' THEN k END AS val FROM e WHERE (event_type = 'purchase' AND k % 6 <> 1) OR (event_type = 'error' AND k % 4 <> 0 AND k % 8 <> 1)),
      l AS (SELECT t.run, t.ord, c, max_by({{'v': val}}, v.ord) AS z FROM e t JOIN v ON v.run = t.run AND v.epoch = t.epoch AND v.ord < t.ord WHERE t.rec_type = 'PTR' GROUP BY ALL)
      SELECT t.run, t.ord, coalesce(string_agg(c || '=' || z.v, ',' ORDER BY c) FILTER (z.v IS NOT NULL), '') AS cond FROM (SELECT run, ord FROM e WHERE rec_type = 'PTR') t LEFT JOIN l USING (run, ord) GROUP BY t.run, t.ord""",
    "static_inherit": f"""WITH {_E}, t AS (SELECT run, ord, k % 7 AS test_num, CASE WHEN k % 3 = 0 THEN '' ELSE 'T' || k END AS test_txt, 'V' AS units, CASE WHEN k % 2 = 0 THEN value END AS lo, value AS hi, CASE WHEN k % 5 = 0 THEN NULL ELSE list_extract([0, 16, 32, 64, 128], k % 5 + 1) END AS f FROM x WHERE rec_type = 'PTR'),
      w AS (SELECT *, first_value({{'t': test_txt, 'u': units, 'lo': lo, 'hi': hi}}) OVER (PARTITION BY run, test_num ORDER BY ord) AS z FROM t)
      SELECT run, ord, test_num, coalesce(nullif(test_txt, ''), z.t) AS test_txt, units, CASE WHEN f IS NULL THEN coalesce(lo, z.lo) WHEN f & 64 <> 0 THEN NULL WHEN f & 16 <> 0 THEN z.lo ELSE lo END AS lo, CASE WHEN f IS NULL THEN coalesce(hi, z.hi) WHEN f & 128 <> 0 THEN NULL WHEN f & 32 <> 0 THEN z.hi ELSE hi END AS hi FROM w""",
}
