"""Measurement queries. Line items stand for measurements: test = part number mod 50, result = extended price, site = line number,
part = order, run A before 1998-06, B from then on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import measure as M
from lodestone.session import table

SPLIT = "1998-06-01"


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.pmod("l_partkey", F.lit(50)).alias("test"), F.col("l_extendedprice").alias("result"), F.col("l_linenumber").alias("site"), F.col("l_orderkey").alias("part"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_shipdate") < SPLIT, "A").otherwise("B").alias("run"), F.year("l_shipdate").alias("year"),
        F.when(F.col("l_discount") < 0.09, 1).otherwise(0).alias("passed"), F.lit(1000.0).alias("lo"), (F.lit(90000.0) + F.when((F.pmod("l_partkey", F.lit(50)) < 10) & (F.col("l_shipdate") >= SPLIT), 500.0).otherwise(0.0)).alias("hi"),
    )


def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return M.summary_stats(measurements(spark, sf), ["test", "run"])


def capability(spark: SparkSession, sf: str) -> DataFrame:
    return M.capabilities(measurements(spark, sf), ["test", "run"])


def classify_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return M.classify_distribution(measurements(spark, sf), ["test"])


def site_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return M.site_dispersion(measurements(spark, sf), ["test"])


def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return M.compare_distributions(measurements(spark, sf), ["test"])


def test_stats_sql(spark: SparkSession, sf: str) -> DataFrame:
    """AG07."""
    s = M.test_stats(measurements(spark, sf), ["test", "run"])
    return s.select("test", "run", "first_seen", "lo", "hi", "n", F.round("mean", 4).alias("mean"), "min", "max", "passed")


def site_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG08."""
    return M.measured(measurements(spark, sf)).groupBy("test", "site").agg(F.count("*").alias("n"), F.round(F.avg("result"), 4).alias("mean"))


def moments_shape(spark: SparkSession, sf: str) -> DataFrame:
    """AG09, AG34, on values scaled to a size at which fourth powers keep their digits."""
    s = M.test_stats(measurements(spark, sf).withColumn("result", F.col("result") / 1e5), ["test"])
    sd = M.spread_of(F.col("mean"), F.col("m2"))
    return s.select("test", "n", *(F.round(c, 6).alias(a) for c, a in (("mean", "m1"), ("m2", "m2"), ("m3", "m3"), ("m4", "m4"))), M.moment_shape(F.col("n"), F.col("mean"), F.col("m2"), F.col("m3"), F.col("m4"), sd).alias("shape"))


def ntile_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = M.quantile_profile(measurements(spark, sf), ["test", "run"])
    return p.select("test", "run", "bucket", F.round("mean", 4).alias("mean"))


def qq_r2_buckets(spark: SparkSession, sf: str) -> DataFrame:
    p = M.qq_r2(M.quantile_profile(measurements(spark, sf), ["test", "run"]), ["test"])
    return p.select("test", F.round("r2", 6).alias("r2"))


def median_mode(spark: SparkSession, sf: str) -> DataFrame:
    return M.median_mode(M.quantile_profile(measurements(spark, sf), ["test"]), ["test"])


def audit_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return M.audit_runs(measurements(spark, sf), ["test"])


def definition_diff(spark: SparkSession, sf: str) -> DataFrame:
    return M.definition_diff(measurements(spark, sf), ["test"], ["lo", "hi"])


def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    return M.audit(measurements(spark, sf), ["test"], "test").drop("first_seen")


def audit_tally(spark: SparkSession, sf: str) -> DataFrame:
    return M.tally(M.audit(measurements(spark, sf), ["test"], "test"))


def problem_rank(spark: SparkSession, sf: str) -> DataFrame:
    """TK05, AU04: flagged tests, worst capability first, then the largest shift."""
    f = M.audit(measurements(spark, sf), ["test"], "test").where("flagged")
    w = M.Window.orderBy(F.coalesce("cpk", F.lit(99.0)), F.desc(F.abs(F.coalesce(F.col("mean_b") - F.col("mean_a"), F.lit(0.0)))), "test")
    return f.select(F.row_number().over(w).cast("bigint").alias("place"), "test", "cpk", "categories")


def _picked(spark: SparkSession, sf: str, cap: int) -> DataFrame:
    f = M.audit(measurements(spark, sf), ["test"], "test")
    return M.balanced_pick(f, "test", F.abs(F.coalesce(F.col("mean_b") - F.col("mean_a"), F.lit(0.0))), cap)


def round_robin_pick(spark: SparkSession, sf: str) -> DataFrame:
    """TK06 with the cap of the operator."""
    return _picked(spark, sf, 48)


def trend_points(spark: SparkSession, sf: str) -> DataFrame:
    return M.trend(measurements(spark, sf), ["test"], "year")


def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    return M.histogram(measurements(spark, sf), ["test"])


def quantile_points(spark: SparkSession, sf: str) -> DataFrame:
    return M.quantile_points(measurements(spark, sf), ["test", "run"], 21)


_M = f"""m AS (SELECT l_partkey % 50 AS test, l_extendedprice AS result, l_linenumber AS site, l_orderkey AS part, l_orderkey * 10 + l_linenumber AS id,
  CASE WHEN l_shipdate < TIMESTAMP '{SPLIT}' THEN 'A' ELSE 'B' END AS run, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_discount < 0.09 THEN 1 ELSE 0 END AS passed, 1000.0::DOUBLE AS lo,
  90000.0::DOUBLE + CASE WHEN l_partkey % 50 < 10 AND l_shipdate >= TIMESTAMP '{SPLIT}' THEN 500.0 ELSE 0.0 END AS hi FROM lineitem)"""
_PROFILE = "pr AS (SELECT test, run, bucket, avg(result) AS mean FROM (SELECT *, ntile(20) OVER (PARTITION BY test, run ORDER BY result) AS bucket FROM m) GROUP BY ALL)"
_R2 = "q AS (SELECT test, CASE WHEN count(*) >= 5 AND var_pop(x.mean) > 0 AND var_pop(y.mean) > 0 THEN corr(x.mean, y.mean) ** 2 END AS r2 FROM (SELECT * FROM pr WHERE run = 'A') x JOIN (SELECT * FROM pr WHERE run = 'B') y USING (test, bucket) GROUP BY test)"
_AUDIT = f"""{_M}, {_PROFILE}, {_R2},
st AS (SELECT test, run, max(lo) AS lo, max(hi) AS hi, count(*) AS n, avg(result) AS mean, avg(result * result) AS m2, avg(result * result * result) AS m3, avg(result * result * result * result) AS m4, min(result) AS mn, max(result) AS mx,
  sqrt(greatest(avg(result * result) - avg(result) * avg(result), 0)) AS sd FROM m GROUP BY test, run),
si AS (SELECT test, count(*) AS sites, max(mu) - min(mu) AS gap FROM (SELECT test, site, avg(result) AS mu FROM m WHERE run = 'B' GROUP BY test, site) GROUP BY test),
j AS (SELECT coalesce(a.test, b.test) AS test, a.test IS NOT NULL AS in_a, b.test IS NOT NULL AS in_b, a.lo AS lo_a, b.lo AS lo_b, a.hi AS hi_a, b.hi AS hi_b, a.mean AS mean_a, b.mean AS mean_b, a.sd AS sd_a, b.sd AS sd_b, b.n AS n_b, b.m2, b.m3, b.m4, b.mn, b.mx
  FROM (SELECT * FROM st WHERE run = 'A') a FULL JOIN (SELECT * FROM st WHERE run = 'B') b ON a.test = b.test),
k AS (SELECT j.*, q.r2, sites, CASE WHEN sites >= 2 AND sd_b > 0 THEN gap / sd_b END AS site_spread, CASE WHEN sd_b > 0 THEN least((mean_b - lo_b) / (3 * sd_b), (hi_b - mean_b) / (3 * sd_b)) END AS cpk_raw,
  m2 - mean_b * mean_b AS var, CASE WHEN sd_b > 0 THEN greatest(abs(mx - mean_b), abs(mn - mean_b)) / sd_b END AS reach,
  CASE WHEN NOT in_a THEN 'new' WHEN NOT in_b THEN 'dropped' WHEN lo_a IS DISTINCT FROM lo_b OR hi_a IS DISTINCT FROM hi_b THEN 'limits' END AS change
  FROM j LEFT JOIN q USING (test) LEFT JOIN si USING (test)),
l AS (SELECT *, CASE WHEN NOT in_b THEN NULL WHEN n_b < 30 OR sd_b <= 0 THEN 'normal' WHEN var <= 0 THEN 'discrete' WHEN (m4 - 4 * mean_b * m3 + 6 * mean_b * mean_b * m2 - 3 * mean_b ** 4) / (var * var) - 3 > 2 THEN 'long-tail'
  WHEN (m4 - 4 * mean_b * m3 + 6 * mean_b * mean_b * m2 - 3 * mean_b ** 4) / (var * var) - 3 < -1.1 THEN 'bimodal' WHEN abs((m3 - 3 * mean_b * m2 + 2 * mean_b ** 3) / var ** 1.5) > 1 THEN 'skewed' ELSE 'normal' END AS shape FROM k),
f AS (SELECT test, change, round(cpk_raw, 4) AS cpk, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(r2, 4) AS qq_r2, shape, round(site_spread, 4) AS site_spread,
  array_to_string(list_filter([CASE WHEN change IS NOT NULL THEN 'changed' END, CASE WHEN in_b AND cpk_raw < 1.33 THEN 'cpk' END,
   CASE WHEN in_a AND in_b AND ((mean_a <> 0 AND abs(mean_b - mean_a) / abs(mean_a) > 0.02) OR (sd_a > 0 AND sd_b > 1.5 * sd_a)) THEN 'shifted' END, CASE WHEN in_a AND in_b AND r2 < 0.95 THEN 'uncorrelated' END,
   CASE WHEN in_b AND (shape NOT IN ('normal', 'discrete') OR reach > 6) THEN 'shape' END, CASE WHEN in_b AND site_spread > 1 THEN 'site' END], lambda x: x IS NOT NULL), ',') AS categories FROM l)"""
_CATS = "e AS (SELECT f.*, unnest(string_split(categories, ',')) AS category FROM f WHERE categories <> '')"

QUERIES = {f.__name__: f for f in (summary_stats, capability, classify_distribution, site_dispersion, compare_runs, test_stats_sql, site_stats, moments_shape, ntile_profile, qq_r2_buckets, median_mode, audit_alignment, definition_diff, audit_findings, audit_tally, problem_rank, round_robin_pick, trend_points, histogram_bins, quantile_points)}
SQL = {
    "summary_stats": f"WITH {_M} SELECT test, run, count(*) AS n, round(avg(result), 4) AS mean, round(quantile_cont(result, 0.5), 4) AS median, round(stddev_pop(result), 4) AS std, min(result) AS min, max(result) AS max FROM m GROUP BY test, run",
    "capability": f"WITH {_M}, g AS (SELECT test, run, count(*) AS n, avg(result) AS mu, stddev_pop(result) AS sd, max(lo) AS lo, max(hi) AS hi FROM m GROUP BY test, run) SELECT test, run, n, round(CASE WHEN sd > 0 AND n >= 2 THEN (mu - lo) / (3 * sd) END, 6) AS cpl, round(CASE WHEN sd > 0 AND n >= 2 THEN (hi - mu) / (3 * sd) END, 6) AS cpu, round(CASE WHEN sd > 0 AND n >= 2 THEN least((mu - lo) / (3 * sd), (hi - mu) / (3 * sd)) END, 6) AS cpk FROM g",
    "classify_distribution": f"""WITH {_M}, g AS (SELECT test, count(*) AS n, avg(result) AS mu, stddev_pop(result) AS sd, kurtosis_pop(result) AS kurt, quantile_cont(result, 0.25) AS q1, quantile_cont(result, 0.75) AS q3, count(DISTINCT result) AS uniq FROM m GROUP BY test),
      z AS (SELECT test, avg(((result - mu) / sd) ** 3) AS skew, avg(CASE WHEN q3 > q1 AND (result < q1 - 1.5 * (q3 - q1) OR result > q3 + 1.5 * (q3 - q1)) THEN 1.0 ELSE 0.0 END) AS outliers FROM m JOIN g USING (test) GROUP BY test),
      x AS (SELECT *, kurt + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) AS den FROM g JOIN z USING (test))
      SELECT test, n, round(skew, 4) AS skew, round(kurt, 4) AS kurt, round(outliers, 6) AS outliers, CASE WHEN n < 8 THEN 'sparse' WHEN sd = 0 THEN 'degenerate' WHEN uniq / n <= 0.05 OR uniq <= 5 THEN 'discrete' WHEN skew > 1 THEN 'long-tail-right' WHEN skew < -1 THEN 'long-tail-left'
       WHEN den > 0 AND (skew * skew + 1) / den > 0.6 THEN 'bimodal' WHEN outliers > 0.03 THEN 'outliers' WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'normal' ELSE 'skewed' END AS shape FROM x""",
    "site_dispersion": f"""WITH {_M}, s AS (SELECT test, site, count(*) AS n, avg(result) AS mu, sum(result) AS s, sum(result * result) AS ss FROM m GROUP BY test, site HAVING count(*) >= 2),
      g AS (SELECT test, count(*) AS sites, CAST(sum(n) AS BIGINT) AS n, max(mu) - min(mu) AS gap, 0.5 + 2.5 / sqrt(min(n)) AS crit, sqrt(greatest(sum(ss) / sum(n) - (sum(s) / sum(n)) ** 2, 0)) AS sd FROM s GROUP BY test)
      SELECT test, sites, n, round(gap / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS spread, round(crit, 6) AS crit, gap / CASE WHEN sd = 0 THEN 1 ELSE sd END > crit AS shift FROM g WHERE sites >= 2 AND n >= 8""",
    "compare_runs": f"""WITH {_M}, g AS (SELECT test, count(*) FILTER (run = 'A') AS n_a, count(*) FILTER (run = 'B') AS n_b, avg(result) FILTER (run = 'A') AS mu_a, avg(result) FILTER (run = 'B') AS mu_b, var_pop(result) FILTER (run = 'A') AS va, var_pop(result) FILTER (run = 'B') AS vb, min(result) AS lo, max(result) AS hi FROM m GROUP BY test),
      v AS (SELECT *, least(n_a, n_b, 256) AS k, CASE WHEN va + vb = 0 THEN 1 ELSE sqrt((va + vb) / 2) END AS pooled FROM g WHERE n_a >= 4 AND n_b >= 4),
      cells AS (SELECT test, cell, sum(count(*) FILTER (run = 'A')) OVER w / max(n_a) AS fa, sum(count(*) FILTER (run = 'B')) OVER w / max(n_b) AS fb FROM (SELECT m.test, run, n_a, n_b, CASE WHEN v.hi > v.lo THEN ceil(round((result - v.lo) / (v.hi - v.lo) * 127, 9)) ELSE 0 END AS cell FROM m JOIN v USING (test)) GROUP BY test, cell WINDOW w AS (PARTITION BY test ORDER BY cell)),
      ks AS (SELECT test, max(abs(fa - fb)) AS ks FROM cells GROUP BY test),
      o AS (SELECT test, run, result, row_number() OVER w - 1 AS at, lead(result) OVER w AS nx FROM m WINDOW w AS (PARTITION BY test, run ORDER BY result)),
      i AS (SELECT test, r.run, i, ((CASE WHEN r.run = 'A' THEN n_a ELSE n_b END) - 1) * (0.02::DOUBLE + i * CASE WHEN k > 1 THEN 0.96::DOUBLE / (k - 1) ELSE 0 END) AS h FROM v, (VALUES ('A'), ('B')) r(run), range(256) t(i) WHERE i < k),
      qs AS (SELECT i.test, i.i, max(CASE WHEN i.run = 'A' THEN result + (h - floor(h)) * (coalesce(nx, result) - result) END) AS qa, max(CASE WHEN i.run = 'B' THEN result + (h - floor(h)) * (coalesce(nx, result) - result) END) AS qb FROM i JOIN o ON o.test = i.test AND o.run = i.run AND o.at = CAST(floor(h) AS BIGINT) GROUP BY i.test, i.i),
      r AS (SELECT test, CASE WHEN stddev_pop(qa) = 0 OR stddev_pop(qb) = 0 THEN CASE WHEN stddev_pop(qa) = 0 AND stddev_pop(qb) = 0 THEN 1 ELSE 0 END ELSE corr(qa, qb) ** 2 END AS r2 FROM qs GROUP BY test)
      SELECT test, round((mu_b - mu_a) / pooled, 4) AS z, round(100 * (mu_b - mu_a) / CASE WHEN mu_a = 0 THEN 1 ELSE abs(mu_a) END, 4) AS pct_shift, round(r2, 4) AS qq_r2, round(ks, 5) AS ks, round(1.63 * sqrt(1 / n_a + 1 / n_b), 5) AS ks_crit,
       ks > 1.3 * 1.63 * sqrt(1 / n_a + 1 / n_b) AS differs, ks > 1.3 * 1.63 * sqrt(1 / n_a + 1 / n_b) AND abs((mu_b - mu_a) / pooled) > 0.5 AS shifted, ks > 1.3 * 1.63 * sqrt(1 / n_a + 1 / n_b) AND abs((mu_b - mu_a) / pooled) <= 0.5 AS uncorrelated FROM v JOIN ks USING (test) JOIN r USING (test)""",
    "test_stats_sql": f"WITH {_M} SELECT test, run, min(id) AS first_seen, max(lo) AS lo, max(hi) AS hi, count(*) AS n, round(avg(result), 4) AS mean, min(result) AS min, max(result) AS max, CAST(sum(passed) AS BIGINT) AS passed FROM m GROUP BY test, run",
    "site_stats": f"WITH {_M} SELECT test, site, count(*) AS n, round(avg(result), 4) AS mean FROM m GROUP BY test, site",
    "moments_shape": f"""WITH {_M}, g AS (SELECT test, count(*) AS n, avg(x) AS m1, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM (SELECT test, result / 1e5 AS x FROM m) GROUP BY test), h AS (SELECT *, m2 - m1 * m1 AS var FROM g)
      SELECT test, n, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(m4, 6) AS m4, CASE WHEN n < 30 OR var <= 0 THEN 'normal' WHEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (var * var) - 3 > 2 THEN 'long-tail' WHEN (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / (var * var) - 3 < -1.1 THEN 'bimodal'
      WHEN abs((m3 - 3 * m1 * m2 + 2 * m1 ** 3) / var ** 1.5) > 1 THEN 'skewed' ELSE 'normal' END AS shape FROM h""",
    "ntile_profile": f"WITH {_M}, {_PROFILE} SELECT test, run, bucket, round(mean, 4) AS mean FROM pr",
    "qq_r2_buckets": f"WITH {_M}, {_PROFILE}, {_R2} SELECT test, round(r2, 6) AS r2 FROM q",
    "median_mode": f"""WITH {_M}, p AS (SELECT test, bucket, avg(result) AS mean FROM (SELECT *, ntile(20) OVER (PARTITION BY test ORDER BY result) AS bucket FROM m) GROUP BY ALL),
      n AS (SELECT *, lead(mean) OVER (PARTITION BY test ORDER BY bucket) AS nx, count(*) OVER (PARTITION BY test) AS k FROM p),
      md AS (SELECT test, round(avg(mean) FILTER (bucket IN ((k + 1) // 2, (k + 2) // 2)), 4) AS median FROM n GROUP BY test), mo AS (SELECT test, round((mean + nx) / 2, 4) AS mode FROM n WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY test ORDER BY round(nx - mean, 9), bucket) = 1)
      SELECT * FROM md LEFT JOIN mo USING (test)""",
    "audit_alignment": f"""WITH {_M}, s AS (SELECT test, run, count(*) AS n, avg(result) AS mean FROM m GROUP BY test, run)
      SELECT coalesce(a.test, b.test) AS test, CASE WHEN a.test IS NULL THEN 'added' WHEN b.test IS NULL THEN 'removed' ELSE 'matched' END AS status, a.n AS n_a, b.n AS n_b, round(a.mean, 4) AS mean_a, round(b.mean, 4) AS mean_b, round(b.mean - a.mean, 4) AS delta FROM (SELECT * FROM s WHERE run = 'A') a FULL JOIN (SELECT * FROM s WHERE run = 'B') b ON a.test = b.test""",
    "definition_diff": f"""WITH {_M}, d AS (SELECT test, run, min_by(lo, id) AS lo, min_by(hi, id) AS hi FROM m GROUP BY test, run), j AS (SELECT coalesce(a.test, b.test) AS test, a.test IS NOT NULL AS in_a, b.test IS NOT NULL AS in_b, array_to_string(list_filter([CASE WHEN a.lo IS DISTINCT FROM b.lo THEN 'lo' END, CASE WHEN a.hi IS DISTINCT FROM b.hi THEN 'hi' END], lambda x: x IS NOT NULL), ',') AS ch
      FROM (SELECT * FROM d WHERE run = 'A') a FULL JOIN (SELECT * FROM d WHERE run = 'B') b ON a.test = b.test) SELECT test, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' WHEN ch <> '' THEN 'changed' ELSE 'identical' END AS status, CASE WHEN in_a AND in_b THEN ch ELSE '' END AS changed FROM j""",
    "audit_findings": f"WITH {_AUDIT} SELECT *, categories <> '' AS flagged, row_number() OVER (ORDER BY coalesce(cpk, 99.0), test) AS rank FROM f",
    "audit_tally": f"WITH {_AUDIT}, {_CATS} SELECT category, count(*) AS tests FROM e GROUP BY category",
    "problem_rank": f"WITH {_AUDIT} SELECT row_number() OVER (ORDER BY coalesce(cpk, 99.0), abs(coalesce(mean_b - mean_a, 0.0)) DESC, test) AS place, test, cpk, categories FROM f WHERE categories <> ''",
    "round_robin_pick": f"""WITH {_AUDIT}, {_CATS}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY abs(coalesce(mean_b - mean_a, 0.0)) DESC, test) AS turn, list_position(['changed', 'cpk', 'shifted', 'uncorrelated', 'shape', 'site'], category) AS place FROM e),
      o AS (SELECT test, category, turn, place FROM t QUALIFY row_number() OVER (PARTITION BY test ORDER BY turn, place) = 1) SELECT * FROM (SELECT row_number() OVER (ORDER BY turn, place, test) AS pick, test, category FROM o) WHERE pick <= 48""",
    "trend_points": f"WITH {_M} SELECT test, year, count(*) AS n, round(avg(result), 4) AS mean, round(quantile_cont(result, 0.5), 4) AS median FROM m GROUP BY test, year",
    "histogram_bins": f"WITH {_M}, e AS (SELECT test, min(result) AS lo, max(result) AS hi FROM m GROUP BY test) SELECT test, run, CAST(CASE WHEN e.hi > e.lo THEN least(floor(round((result - e.lo) / (e.hi - e.lo) * 20, 9)), 19) ELSE 0 END AS INT) AS bin, count(*) AS n FROM m JOIN e USING (test) GROUP BY ALL",
    "quantile_points": f"WITH {_M}, g AS (SELECT test, run, quantile_cont(result, list_transform(range(21), lambda i: i / 20.0)) AS q FROM m GROUP BY test, run) SELECT test, run, CAST(generate_subscripts(q, 1) - 1 AS INT) AS i, round(unnest(q), 4) AS q FROM g",
}
