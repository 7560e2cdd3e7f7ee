"""Queries behind reports: dashboards, problem lists, chunk texts of logs, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import measure as M
from lodestone.operators import parts as P
from lodestone.operators import reports as R
from lodestone.plans import measure as PM
from lodestone.plans import retrieval as PR
from lodestone.session import table


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    return R.analyses(PM.measurements(spark, sf).withColumn("rec_type", F.when(F.pmod("test", F.lit(13)) == 0, "FTR").otherwise("PTR")), ["test"])


def analysis_flags(spark: SparkSession, sf: str) -> DataFrame:
    """AU03."""
    return _analyses(spark, sf).select("test", "status", "shape", F.array_join("flags", ",").alias("flags"), "cpk", "pct_shift", "site_spread")


def problem_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """AU04, AU05, AU17."""
    return R.problems(_analyses(spark, sf), "test")


def dashboard_gallery(spark: SparkSession, sf: str) -> DataFrame:
    """TK06, TK07 with the cap of the operator."""
    return R.gallery(_analyses(spark, sf), "test")


def chip_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT20."""
    return R.chip_filter(_analyses(spark, sf), ["changed", "functional"], ["shifted"]).select("test")


def stats_table(spark: SparkSession, sf: str) -> DataFrame:
    """AU08: the table of statistics of each test of run B."""
    b = PM.measurements(spark, sf).where("run = 'B'")
    s = M.summary_stats(b, ["test"]).select("test", "n", "mean", "std", "min", "max")
    return s.join(M.median_mode(M.quantile_profile(b, ["test"]), ["test"]), "test").join(M.capabilities(b, ["test"]).select("test", "cpl", "cpu", "cpk"), "test")


def test_texts(spark: SparkSession, sf: str) -> DataFrame:
    """TXT18."""
    r = table(spark, sf, "stdf_results").dropDuplicates(["id"])
    return r.select("id", R.test_text(r).alias("text"))


def part_texts(spark: SparkSession, sf: str) -> DataFrame:
    """TXT19."""
    return R.part_texts(P.touchdowns(table(spark, sf, "stdf_parts")), table(spark, sf, "stdf_results").dropDuplicates(["id"]))


def search_payload(spark: SparkSession, sf: str) -> DataFrame:
    """RK20."""
    p = R.payload(PR.bm25_topk(spark, sf))
    return p.select("query_id", F.size("hits").cast("bigint").alias("hits"), F.size("documents").cast("bigint").alias("documents"), F.array_join(F.transform("documents", lambda d: d["doc_id"].cast("string")), ",").alias("doc_ids"))


def reference_labels(spark: SparkSession, sf: str) -> DataFrame:
    """RK25, JN12."""
    c = table(spark, sf, "chunks").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id"), "locator")
    return R.reference_labels(c.join(table(spark, sf, "documents").select("doc_id", "path", "title", "source"), "doc_id"))


def mixed_formats(spark: SparkSession, sf: str) -> DataFrame:
    """TXT31."""
    return R.mixed_formats(table(spark, sf, "documents").select("path"), ["pdf", "docx", "md", "pptx", "xlsx"])


def report_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """SNK26: documents' times stand for reports'."""
    return table(spark, sf, "documents").select("doc_id", R.expires_at(F.col("ingested_at"), 0).alias("keep_0"), R.expires_at(F.col("ingested_at"), 3).alias("keep_3"))


_A = f"""WITH {PM._M}, d AS (SELECT test, run, min_by(lo, id) AS lo, min_by(hi, id) AS hi FROM m GROUP BY test, run), st AS (SELECT coalesce(a.test, b.test) AS test, CASE WHEN a.test IS NULL THEN 'added' WHEN b.test IS NULL THEN 'removed' WHEN a.lo IS DISTINCT FROM b.lo OR a.hi IS DISTINCT FROM b.hi THEN 'changed' ELSE 'identical' END AS status, coalesce(b.lo, a.lo) AS lo, coalesce(b.hi, a.hi) AS hi
  FROM (SELECT * FROM d WHERE run = 'A') a FULL JOIN (SELECT * FROM d WHERE run = 'B') b ON a.test = b.test),
now AS (SELECT * FROM m WHERE run = 'B' OR test NOT IN (SELECT test FROM m WHERE run = 'B')),
shp AS ({PM.SQL['classify_distribution'].replace('WITH ' + PM._M + ', g AS', 'WITH g AS').replace('FROM m', 'FROM now')}),
cmp AS ({PM.SQL['compare_runs'].replace('WITH ' + PM._M + ', g AS', 'WITH g AS')}),
sit AS ({PM.SQL['site_dispersion'].replace('WITH ' + PM._M + ', s AS', 'WITH s AS').replace('FROM m', "FROM (SELECT * FROM m WHERE run = 'B')")}),
gg AS (SELECT test, count(*) AS n, avg(result) AS mu, stddev_pop(result) AS sd FROM now GROUP BY test),
an AS (SELECT test, status, coalesce(shape, 'sparse') AS shape, round(CASE WHEN sd > 0 AND gg.n >= 2 THEN least((mu - lo) / (3 * sd), (hi - mu) / (3 * sd)) END, 4) AS cpk, z, pct_shift, spread AS site_spread,
  list_filter([status, CASE WHEN shifted THEN 'shifted' END, CASE WHEN NOT differs THEN 'correlated' END, CASE WHEN uncorrelated THEN 'uncorrelated' END, CASE WHEN shift THEN 'site-shift' END, CASE WHEN test % 13 = 0 THEN 'functional' END,
   CASE shape WHEN 'bimodal' THEN 'bimodal' WHEN 'long-tail-right' THEN 'long-tail' WHEN 'long-tail-left' THEN 'long-tail' WHEN 'outliers' THEN 'outliers' WHEN 'discrete' THEN 'discrete' END], lambda x: x IS NOT NULL) AS flags
  FROM st LEFT JOIN gg USING (test) LEFT JOIN shp USING (test) LEFT JOIN cmp USING (test) LEFT JOIN sit USING (test))"""
_R = "r AS (SELECT DISTINCT ON (id) * FROM stdf_results)"

QUERIES = {f.__name__: f for f in (analysis_flags, problem_reasons, dashboard_gallery, chip_filter, stats_table, test_texts, part_texts, search_payload, reference_labels, mixed_formats, report_expiry)}
SQL = {
    "analysis_flags": _A + " SELECT test, status, shape, array_to_string(flags, ',') AS flags, cpk, pct_shift, site_spread FROM an",
    "problem_reasons": _A + """ SELECT row_number() OVER (ORDER BY coalesce(cpk, 99.0), abs(coalesce(pct_shift, 0)) DESC, test) AS place, test, cpk, array_to_string(list_filter([CASE WHEN cpk < 1.33 THEN 'Cpk ' || printf('%.2f', cpk) || ' (below 1.33)' END, CASE WHEN list_contains(flags, 'added') THEN 'new test in this run' END,
      CASE WHEN list_contains(flags, 'removed') THEN 'dropped since the last run' END, CASE WHEN list_contains(flags, 'changed') THEN 'limits or test number changed' END, CASE WHEN list_contains(flags, 'shifted') THEN 'mean moved ' || printf('%+.1f', pct_shift) || '%' END, CASE WHEN list_contains(flags, 'uncorrelated') THEN 'run-to-run correlation lost' END,
      CASE WHEN list_contains(flags, 'site-shift') THEN 'site-to-site spread' END, CASE WHEN list_contains(flags, 'bimodal') THEN 'bimodal' END, CASE WHEN list_contains(flags, 'long-tail') THEN 'long tail' END, CASE WHEN list_contains(flags, 'outliers') THEN 'outliers' END], lambda x: x IS NOT NULL), '; ') AS reason
      FROM an WHERE cpk < 1.33 OR list_has_any(flags, ['added', 'removed', 'changed', 'shifted', 'uncorrelated', 'site-shift', 'bimodal', 'long-tail', 'outliers'])""",
    "dashboard_gallery": _A + """, sc AS (SELECT test, round(abs(coalesce(z, 0)) + CASE WHEN list_contains(flags, 'uncorrelated') THEN 3.0 ELSE 0.0 END + CASE WHEN status IN ('added', 'removed') THEN 1.5 ELSE 0.0 END + CASE WHEN list_has_any(flags, ['bimodal', 'long-tail', 'outliers']) THEN 1.0 ELSE 0.0 END, 6) AS score, unnest(flags) AS category FROM an),
      tn AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, test) AS turn, list_position(['uncorrelated', 'shifted', 'added', 'removed', 'bimodal', 'outliers', 'long-tail', 'discrete', 'correlated'], category) AS place FROM sc WHERE category IN ('uncorrelated', 'shifted', 'added', 'removed', 'bimodal', 'outliers', 'long-tail', 'discrete', 'correlated')),
      oo AS (SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY test ORDER BY turn, place) = 1) SELECT * FROM (SELECT row_number() OVER (ORDER BY turn, place, test) AS pick, test, category FROM oo) WHERE pick <= 48""",
    "chip_filter": _A + " SELECT test FROM an WHERE list_has_any(flags, ['changed', 'functional']) AND NOT list_contains(flags, 'shifted')",
    "stats_table": f"""WITH {PM._M}, b AS (SELECT * FROM m WHERE run = 'B'), s AS (SELECT test, count(*) AS n, avg(result) AS mu, stddev_pop(result) AS sd, min(result) AS min, max(result) AS max, max(lo) AS lo, max(hi) AS hi FROM b GROUP BY test),
      p AS (SELECT test, bucket, avg(result) AS mean FROM (SELECT *, ntile(20) OVER (PARTITION BY test ORDER BY result) AS bucket FROM b) GROUP BY ALL), x AS (SELECT *, lead(mean) OVER (PARTITION BY test ORDER BY bucket) AS nx, count(*) OVER (PARTITION BY test) AS k FROM p),
      md AS (SELECT test, round(avg(mean) FILTER (bucket IN ((k + 1) // 2, (k + 2) // 2)), 4) AS median FROM x GROUP BY test), mo AS (SELECT test, round((mean + nx) / 2, 4) AS mode FROM x WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY test ORDER BY round(nx - mean, 9), bucket) = 1)
      SELECT test, n, round(mu, 4) AS mean, round(sd, 4) AS std, min, max, median, mode, round(CASE WHEN sd > 0 THEN (mu - lo) / (3 * sd) END, 6) AS cpl, round(CASE WHEN sd > 0 THEN (hi - mu) / (3 * sd) END, 6) AS cpu, round(CASE WHEN sd > 0 THEN least((mu - lo) / (3 * sd), (hi - mu) / (3 * sd)) END, 6) AS cpk FROM s JOIN md USING (test) LEFT JOIN mo USING (test)""",
    "test_texts": f"""WITH {_R}, c AS (SELECT id, string_agg(k || '=' || json_extract_string(conditions, '$."' || k || '"'), ' ' ORDER BY k) AS cond FROM (SELECT *, unnest(json_keys(conditions)) AS k FROM r WHERE conditions IS NOT NULL) GROUP BY id)
      SELECT id, concat_ws(' ', CASE WHEN coalesce(test_txt, '') <> '' THEN test_txt ELSE 'test ' || test_num END, 'test ' || test_num, CASE WHEN result IS NOT NULL AND NOT isnan(result) THEN 'result ' || printf('%g', result) END, CASE WHEN passed = 1 THEN 'PASS' ELSE 'FAIL' END, 'part ' || coalesce(part_id, '') || ' head ' || head || ' site ' || coalesce(CAST(site AS VARCHAR), ''), 'COND ' || cond) AS text FROM r LEFT JOIN c USING (id)""",
    "part_texts": f"""WITH {_R}, p AS (SELECT DISTINCT ON (id) * REPLACE (regexp_replace(lower(trim(coalesce(insertion, ''))), '[\\s_-]+', ' ', 'g') AS insertion) FROM stdf_parts), n AS (SELECT doc_id, part_id, count(*) AS tests, sum(passed) AS good FROM r GROUP BY ALL)
      SELECT p.id, p.doc_id, concat_ws(' ', 'part', coalesce(p.part_id, 'None'), 'insertion', p.insertion, 'wafer', coalesce(wafer, ''), 'x', coalesce(CAST(x AS VARCHAR), 'None'), 'y', coalesce(CAST(y AS VARCHAR), 'None'), 'bin', hard_bin, CASE WHEN passed = 1 THEN 'PASS' ELSE 'FAIL' END, coalesce(tests, 0), 'tests', coalesce(good, 0), 'pass') AS text FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.part_id = p.part_id""",
    "search_payload": PR._TOPK + " SELECT query_id, count(*) AS hits, count(DISTINCT doc_id) AS documents, (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT doc_id AS d FROM k k2 WHERE k2.query_id = k.query_id)) AS doc_ids FROM k GROUP BY query_id",
    "reference_labels": "WITH c AS (SELECT DISTINCT ON (id) * FROM chunks) SELECT id AS chunk_id, concat_ws(' — ', nullif(source, ''), coalesce(title, path), nullif(trim(locator), '')) AS label FROM c JOIN documents ON doc_id = document_id",
    "mixed_formats": "SELECT path, list_extract(['pdf', 'docx', 'md', 'pptx', 'xlsx'], CAST((row_number() OVER (ORDER BY path) - 1) % 5 + 1 AS INT)) AS format FROM documents",
    "report_expiry": "WITH e AS (SELECT doc_id, ingested_at + INTERVAL 12 HOUR AS a, ingested_at + INTERVAL 72 HOUR AS b FROM documents) SELECT doc_id, CASE WHEN date_trunc('day', a) = a THEN a ELSE date_trunc('day', a) + INTERVAL 1 DAY END AS keep_0, CASE WHEN date_trunc('day', b) = b THEN b ELSE date_trunc('day', b) + INTERVAL 1 DAY END AS keep_3 FROM e",
}
