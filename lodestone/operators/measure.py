"""Measurement statistics, capability, shape, comparison of runs, and audits.

Inputs are long tables of measurements: run, test, site, part, id, result, lo, hi, passed (as needed). Null, NaN and
infinite results never count. Every statistic is a grouped aggregate with partial aggregation, or a window per
(test, run); nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import finite

# Fixed thresholds of the audit.
CPK, MEAN_SHIFT, SPREAD, QQ_R2, REACH, SITE = 1.33, 0.02, 1.5, 0.95, 6.0, 1.0
BUCKETS, GRID, QUANTILES = 20, 128, 256


def measured(df: DataFrame, value: str = "result") -> DataFrame:
    """FLT14: finite results only."""
    return df.where(finite(F.col(value)))


def _r(c: Column, dp: int = 6) -> Column:
    return F.round(c, dp)


def summary_stats(df: DataFrame, by: list[str], value: str = "result") -> DataFrame:
    """AG01: n, mean, median, population std, min, max."""
    v = F.col(value)
    return measured(df, value).groupBy(*by).agg(F.count("*").alias("n"), _r(F.avg(v), 4).alias("mean"), _r(F.percentile(v, 0.5), 4).alias("median"), _r(F.stddev_pop(v), 4).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def spread_of(mean: Column, mean_sq: Column) -> Column:
    """FN05: standard deviation out of two raw moments, 0 below 0."""
    return F.sqrt(F.greatest(mean_sq - mean * mean, F.lit(0.0)))


def capability(mean: Column, std: Column, lo: Column, hi: Column, n: Column | None = None) -> tuple[Column, Column, Column]:
    """AG02: Cpl, Cpu, Cpk; null without spread or with fewer than two values, Cpk the least of those there are."""
    ok = (std > 0) if n is None else (std > 0) & (n >= 2)
    cpl = F.when(ok, (mean - lo) / (3 * std))
    cpu = F.when(ok, (hi - mean) / (3 * std))
    return cpl, cpu, F.least(cpl, cpu)


def capabilities(df: DataFrame, by: list[str]) -> DataFrame:
    g = measured(df).groupBy(*by).agg(F.count("*").alias("n"), F.avg("result").alias("mu"), F.stddev_pop("result").alias("sd"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    cpl, cpu, cpk = capability(F.col("mu"), F.col("sd"), F.col("lo"), F.col("hi"), F.col("n"))
    return g.select(*by, "n", _r(cpl).alias("cpl"), _r(cpu).alias("cpu"), _r(cpk).alias("cpk"))


def classify_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """AG03: shape of each group's values by the fixed rules, in their order."""
    m = measured(df)
    g = m.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("result").alias("sd"), F.skewness("result").alias("skew"), F.kurtosis("result").alias("kurt"), F.percentile("result", 0.25).alias("q1"), F.percentile("result", 0.75).alias("q3"), F.count_distinct("result").alias("uniq"))
    iqr = F.col("q3") - F.col("q1")
    out = m.join(g.select(*by, "q1", "q3"), by).groupBy(*by).agg(F.avg(F.when((iqr > 0) & ((F.col("result") < F.col("q1") - 1.5 * iqr) | (F.col("result") > F.col("q3") + 1.5 * iqr)), 1.0).otherwise(0.0)).alias("outliers"))
    n = F.col("n")
    den = F.col("kurt") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    bc = F.when(den > 0, (F.col("skew") * F.col("skew") + 1) / den).otherwise(0.0)
    shape = (
        F.when(n < 8, "sparse").when(F.col("sd") == 0, "degenerate").when((F.col("uniq") / n <= 0.05) | (F.col("uniq") <= 5), "discrete")
        .when(F.col("skew") > 1, "long-tail-right").when(F.col("skew") < -1, "long-tail-left").when(bc > 0.6, "bimodal").when(F.col("outliers") > 0.03, "outliers")
        .when((F.abs("skew") < 0.5) & (F.abs("kurt") < 1), "normal").otherwise("skewed")
    )
    return g.join(out, by).select(*by, "n", _r(F.col("skew"), 4).alias("skew"), _r(F.col("kurt"), 4).alias("kurt"), _r(F.col("outliers")).alias("outliers"), shape.alias("shape"))


def site_dispersion(df: DataFrame, by: list[str]) -> DataFrame:
    """AG04: spread of site means in pooled standard deviations, against a limit by the smallest site."""
    s = measured(df).where("site IS NOT NULL").groupBy(*by, "site").agg(F.count("*").alias("n"), F.avg("result").alias("mu"), F.sum("result").alias("s"), F.sum(F.col("result") * F.col("result")).alias("ss")).where("n >= 2")
    g = s.groupBy(*by).agg(F.count("*").alias("sites"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("mu").alias("hi"), F.min("mu").alias("lo"), (F.sum("s") / F.sum("n")).alias("m"), (F.sum("ss") / F.sum("n")).alias("m2"))
    sd = spread_of(F.col("m"), F.col("m2"))
    spread = (F.col("hi") - F.col("lo")) / F.when(sd == 0, 1.0).otherwise(sd)
    crit = 0.5 + 2.5 / F.sqrt("least")
    return g.where("sites >= 2 AND n >= 8").select(*by, "sites", "n", _r(spread, 5).alias("spread"), _r(crit).alias("crit"), (spread > crit).alias("shift"))


def compare_distributions(df: DataFrame, by: list[str], run: str = "run", a: str = "A", b: str = "B") -> DataFrame:
    """AG05: two runs by pooled mean shift, matched quantiles (at most 256) and a two-sample KS distance on a grid of 128 points."""
    m = measured(df).where(F.col(run).isin(a, b)).select(*by, run, "result")
    side = lambda f, x: F.max(F.when(F.col(run) == x, f))
    st = m.groupBy(*by, run).agg(F.count("*").alias("n"), F.avg("result").alias("mu"), F.var_pop("result").alias("var"), F.min("result").alias("lo"), F.max("result").alias("hi"))
    g = st.groupBy(*by).agg(*(side(F.col(c), x).alias(f"{c}_{k}") for c in ("n", "mu", "var") for x, k in ((a, "a"), (b, "b"))), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    g = g.where("n_a >= 4 AND n_b >= 4")
    pooled = F.sqrt((F.col("var_a") + F.col("var_b")) / 2)
    g = g.withColumn("pooled", F.when(pooled == 0, 1.0).otherwise(pooled)).withColumn("k", F.least("n_a", "n_b", F.lit(QUANTILES)))
    # distribution functions on the grid: the first grid point not below a value, counted and summed up
    span = F.col("hi") - F.col("lo")
    cell = F.when(span > 0, F.ceil(_r((F.col("result") - F.col("lo")) / span * (GRID - 1), 9))).otherwise(F.lit(0)).cast("int")
    cells = m.join(g.select(*by, "lo", "hi"), by).groupBy(*by, cell.alias("cell")).agg(F.sum(F.when(F.col(run) == a, 1).otherwise(0)).alias("ca"), F.sum(F.when(F.col(run) == b, 1).otherwise(0)).alias("cb"))
    w = Window.partitionBy(*by).orderBy("cell")
    cells = cells.withColumn("fa", F.sum("ca").over(w)).withColumn("fb", F.sum("cb").over(w))
    ks = cells.join(g.select(*by, "n_a", "n_b"), by).groupBy(*by).agg(F.max(F.abs(F.col("fa") / F.col("n_a") - F.col("fb") / F.col("n_b"))).alias("ks"))
    # matched quantiles by linear interpolation between neighbours in rank
    rank = Window.partitionBy(*by, run).orderBy("result")
    ordered = m.withColumn("at", F.row_number().over(rank) - 1).withColumn("next", F.lead("result").over(rank))
    step = F.when(F.col("k") > 1, 0.96 / (F.col("k") - 1)).otherwise(0.0)
    want = g.select(*by, "n_a", "n_b", "k", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("i"))
    want = want.select(*by, "i", F.explode(F.array(F.struct(F.lit(a).alias("r"), F.col("n_a").alias("n")), F.struct(F.lit(b).alias("r"), F.col("n_b").alias("n")))).alias("s"), (0.02 + F.col("i") * step).alias("p"))
    h = (F.col("s.n") - 1) * F.col("p")
    want = want.select(*by, "i", F.col("s.r").alias(run), F.floor(h).cast("int").alias("at"), (h - F.floor(h)).alias("frac"))
    q = want.join(ordered, [*by, run, "at"]).select(*by, "i", run, (F.col("result") + F.col("frac") * (F.coalesce("next", "result") - F.col("result"))).alias("q"))
    q = q.groupBy(*by, "i").agg(side(F.col("q"), a).alias("qa"), side(F.col("q"), b).alias("qb"))
    r = q.groupBy(*by).agg(F.covar_pop("qa", "qb").alias("cov"), F.stddev_pop("qa").alias("sa"), F.stddev_pop("qb").alias("sb"))
    corr = F.try_divide(F.col("cov"), F.col("sa") * F.col("sb"))
    r2 = F.when((F.col("sa") == 0) | (F.col("sb") == 0), F.when((F.col("sa") == 0) & (F.col("sb") == 0), 1.0).otherwise(0.0)).otherwise(corr * corr)
    z = (F.col("mu_b") - F.col("mu_a")) / F.col("pooled")
    crit = 1.63 * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    differs = F.col("ks") > 1.3 * crit
    moved = F.abs(z) > 0.5
    pct = 100 * (F.col("mu_b") - F.col("mu_a")) / F.when(F.col("mu_a") == 0, 1.0).otherwise(F.abs("mu_a"))
    out = g.join(ks, by).join(r, by)
    return out.select(*by, _r(z, 4).alias("z"), _r(pct, 4).alias("pct_shift"), _r(r2, 4).alias("qq_r2"), _r(F.col("ks"), 5).alias("ks"), _r(crit, 5).alias("ks_crit"), differs.alias("differs"), (differs & moved).alias("shifted"), (differs & ~moved).alias("uncorrelated"))


def test_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """AG07 and AG09 in one pass: counts, first row, limits, raw moments."""
    x = F.col("result")
    return measured(df).groupBy(*by).agg(
        F.min("id").alias("first_seen"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.avg(x).alias("mean"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"),
        F.avg(x * x * x * x).alias("m4"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum("passed").alias("passed"),
    )


def moment_shape(n: Column, m1: Column, m2: Column, m3: Column, m4: Column, spread: Column) -> Column:
    """AG34."""
    var = m2 - m1 * m1
    s3 = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.pow(var, F.lit(1.5))
    s4 = (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3
    return F.when((n < 30) | (spread <= 0), "normal").when(var <= 0, "discrete").when(s4 > 2, "long-tail").when(s4 < -1.1, "bimodal").when(F.abs(s3) > 1, "skewed").otherwise("normal")


def quantile_profile(df: DataFrame, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """WN01, WN02: mean of each of the ``buckets`` equal parts of the ordered values."""
    w = Window.partitionBy(*by).orderBy("result")
    return measured(df).withColumn("bucket", F.ntile(buckets).over(w).cast("bigint")).groupBy(*by, "bucket").agg(F.avg("result").alias("mean"))


def qq_r2(profile: DataFrame, by: list[str], run: str = "run", a: str = "A", b: str = "B") -> DataFrame:
    """AU07: squared correlation of bucket means; null below five buckets or without variance."""
    x = profile.where(F.col(run) == a).select(*by, "bucket", F.col("mean").alias("x"))
    y = profile.where(F.col(run) == b).select(*by, "bucket", F.col("mean").alias("y"))
    g = x.join(y, [*by, "bucket"]).groupBy(*by).agg(F.count("*").alias("k"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return g.select(*by, F.when((F.col("k") >= 5) & (F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))).alias("r2"))


def median_mode(profile: DataFrame, by: list[str]) -> DataFrame:
    """AG33: median out of the middle buckets, mode as the middle of the closest pair of neighbours, the first of ties."""
    w = Window.partitionBy(*by).orderBy("bucket")
    p = profile.withColumn("next", F.lead("mean").over(w)).withColumn("k", F.count("*").over(Window.partitionBy(*by)))
    mid = F.avg(F.when((F.col("bucket") == F.floor((F.col("k") + 1) / 2)) | (F.col("bucket") == F.floor((F.col("k") + 2) / 2)), F.col("mean")))
    gap = F.when(F.col("next").isNotNull(), F.struct(_r(F.col("next") - F.col("mean"), 9), F.col("bucket")))
    return p.groupBy(*by).agg(_r(mid, 4).alias("median"), _r(F.min_by((F.col("mean") + F.col("next")) / 2, gap), 4).alias("mode"))


def _pair(df: DataFrame, by: list[str], run: str, a: str, b: str, cols: list[str]) -> DataFrame:
    """JN17: full outer alignment of two runs; run A's columns end in _a, B's in _b, with flags in_a and in_b."""
    left = df.where(F.col(run) == a).select(*by, F.lit(True).alias("in_a"), *(F.col(c).alias(f"{c}_a") for c in cols))
    right = df.where(F.col(run) == b).select(*by, F.lit(True).alias("in_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    return left.join(right, by, "full").withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))


def audit_runs(df: DataFrame, by: list[str]) -> DataFrame:
    """AU01, SET02: per test of two runs: where it is, counts, means, their difference."""
    st = measured(df).groupBy(*by, "run").agg(F.count("*").alias("n"), F.avg("result").alias("mean"), F.stddev_pop("result").alias("std"))
    p = _pair(st, by, "run", "A", "B", ["n", "mean", "std"])
    where = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").otherwise("matched")
    return p.select(*by, where.alias("status"), "n_a", "n_b", _r(F.col("mean_a"), 4).alias("mean_a"), _r(F.col("mean_b"), 4).alias("mean_b"), _r(F.col("mean_b") - F.col("mean_a"), 4).alias("delta"))


def definition_diff(df: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """AU02, JN16, WN05: the first definition of each test in two runs and the fields in which they differ."""
    first = df.groupBy(*by, "run").agg(F.min_by(F.struct(*fields), "id").alias("d")).select(*by, "run", *(F.col("d")[f].alias(f) for f in fields))
    p = _pair(first, by, "run", "A", "B", fields)
    changed = F.array_compact(F.array(*(F.when(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), F.lit(f)) for f in fields)))
    status = F.when(~F.col("in_a"), "added").when(~F.col("in_b"), "removed").when(F.size(changed) > 0, "changed").otherwise("identical")
    return p.select(*by, status.alias("status"), F.when(F.col("in_a") & F.col("in_b"), F.array_join(changed, ",")).otherwise("").alias("changed"))


def audit(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """AU06: the six categories of each test of two runs (A before, B now), with figures and disposition. ``name`` is the column that orders ties.

    One aggregate for statistics and moments, one ntile pass, one pass over sites, joined on the test."""
    st = test_stats(df, [*by, "run"])
    sd = spread_of(F.col("mean"), F.col("m2"))
    st = st.withColumn("sd", F.when(sd > 0, sd).otherwise(0.0))
    cols = ["first_seen", "lo", "hi", "n", "mean", "m2", "m3", "m4", "min", "max", "sd"]
    p = _pair(st, by, "run", "A", "B", cols)
    r2 = qq_r2(quantile_profile(df, [*by, "run"]), by)
    s = measured(df).where("run = 'B' AND site IS NOT NULL").groupBy(*by, "site").agg(F.avg("result").alias("mu"))
    s = s.groupBy(*by).agg(F.count("*").alias("sites"), F.max("mu").alias("site_hi"), F.min("mu").alias("site_lo"))
    p = p.join(r2, by, "left").join(s, by, "left")
    both, c = F.col("in_a") & F.col("in_b"), F.col
    _, _, cpk = capability(c("mean_b"), c("sd_b"), c("lo_b"), c("hi_b"))
    shape = moment_shape(c("n_b"), c("mean_b"), c("m2_b"), c("m3_b"), c("m4_b"), c("sd_b"))
    reach = F.when(c("sd_b") > 0, F.greatest(F.abs(c("max_b") - c("mean_b")), F.abs(c("min_b") - c("mean_b"))) / c("sd_b"))
    dispersion = F.when((c("sites") >= 2) & (c("sd_b") > 0), (c("site_hi") - c("site_lo")) / c("sd_b"))
    change = F.when(~c("in_a"), "new").when(~c("in_b"), "dropped").when(~c("lo_a").eqNullSafe(c("lo_b")) | ~c("hi_a").eqNullSafe(c("hi_b")), "limits")
    shifted = both & (((c("mean_a") != 0) & (F.abs(c("mean_b") - c("mean_a")) / F.abs(c("mean_a")) > MEAN_SHIFT)) | ((c("sd_a") > 0) & (c("sd_b") > SPREAD * c("sd_a"))))
    odd = c("in_b") & ~shape.isin("normal", "discrete")
    marks = [(change.isNotNull(), "changed"), (c("in_b") & (cpk < CPK), "cpk"), (shifted, "shifted"), (both & (c("r2") < QQ_R2), "uncorrelated"), (odd | (c("in_b") & (reach > REACH)), "shape"), (c("in_b") & (dispersion > SITE), "site")]
    cats = F.array_compact(F.array(*(F.when(m, F.lit(t)) for m, t in marks)))
    out = p.select(
        *by, change.alias("change"), _r(F.when(c("in_b"), cpk), 4).alias("cpk"), _r(c("mean_a"), 4).alias("mean_a"), _r(c("mean_b"), 4).alias("mean_b"), _r(c("r2"), 4).alias("qq_r2"),
        F.when(c("in_b"), shape).alias("shape"), _r(dispersion, 4).alias("site_spread"), F.coalesce("first_seen_b", "first_seen_a").alias("first_seen"), F.array_join(cats, ",").alias("categories"),
    )
    w = Window.orderBy(F.coalesce("cpk", F.lit(99.0)), name)  # one row for each test, not for each measurement
    return out.withColumn("flagged", F.col("categories") != "").withColumn("rank", F.row_number().over(w).cast("bigint"))


def tally(findings: DataFrame) -> DataFrame:
    """AG40: tests in each category."""
    return findings.select(F.explode(F.split("categories", ",")).alias("category")).where("category <> ''").groupBy("category").agg(F.count("*").alias("tests"))


def balanced_pick(findings: DataFrame, name: str, score: Column, cap: int, categories: tuple[str, ...] = ("changed", "cpk", "shifted", "uncorrelated", "shape", "site")) -> DataFrame:
    """TK06: categories take turns, best score first in each; a name already taken uses up its turn, not a place. Nothing flagged, the first names, without a category."""
    order = {c: i for i, c in enumerate(categories)}
    e = findings.withColumn("score", score).select(name, "score", F.explode(F.split(F.coalesce("categories", F.lit("")), ",")).alias("category"))
    e = e.withColumn("turn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), name)))
    place = reduce(lambda w, kv: w.when(F.col("category") == kv[0], kv[1]), order.items(), F.when(F.lit(False), -1))
    first = e.groupBy(name).agg(F.min(F.when(F.col("category") != "", F.struct("turn", place.alias("place"), "category"))).alias("f"))
    first = first.withColumn("flagged", F.count("f").over(Window.partitionBy())).where("f IS NOT NULL OR flagged = 0")
    w = Window.orderBy("f.turn", "f.place", name)
    return first.withColumn("pick", F.row_number().over(w).cast("bigint")).where(F.col("pick") <= cap).select("pick", name, F.col("f.category").alias("category"))


def trend(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """AG26: mean, median and count of each run in order; runs without values are skipped."""
    return measured(df).groupBy(*by, order).agg(F.count("*").alias("n"), _r(F.avg("result"), 4).alias("mean"), _r(F.percentile("result", 0.5), 4).alias("median"))


def histogram(df: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """AU15: counts over equal bins of the joint range of a test's series; the last bin is closed."""
    m = measured(df)
    edge = m.groupBy(*by).agg(F.min("result").alias("low"), F.max("result").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor(_r((F.col("result") - F.col("low")) / (F.col("high") - F.col("low")) * bins, 9)), F.lit(bins - 1))).otherwise(F.lit(0))
    return m.join(edge, by).groupBy(*by, "run", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quantile_points(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """AG06: evenly spaced linear quantiles."""
    ps = [i / (n - 1) for i in range(n)]
    g = measured(df).groupBy(*by).agg(F.percentile("result", F.array(*map(F.lit, ps))).alias("q"))
    return g.select(*by, F.posexplode("q").alias("i", "q")).select(*by, "i", _r(F.col("q"), 4).alias("q"))
