"""What reports are made of: flags and reasons of tests, chunk texts of logs, compact replies, selector proposals, expiry."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.operators import measure as M

# Shapes that are flags, flags that are problems, categories of the gallery in their order.
SHAPE_FLAG = {"bimodal": "bimodal", "long-tail-right": "long-tail", "long-tail-left": "long-tail", "outliers": "outliers", "discrete": "discrete"}
PROBLEMS = ("added", "removed", "changed", "shifted", "uncorrelated", "site-shift", "bimodal", "long-tail", "outliers")
GALLERY = ("uncorrelated", "shifted", "added", "removed", "bimodal", "outliers", "long-tail", "discrete", "correlated")


def analyses(df: DataFrame, by: list[str]) -> DataFrame:
    """AU03, MS13, MS14: per test of runs A and B: status, shape of the current values, flags, capability, site spread. ``df`` has run, id, lo, hi, site, result, rec_type."""
    status = M.definition_diff(df, by, ["lo", "hi"]).select(*by, "status")
    # the values of B where there are any, else those of A
    has_b = M.measured(df).where("run = 'B'").select(*by).distinct().withColumn("has_b", F.lit(True))
    now = M.measured(df).join(has_b, by, "left").where((F.col("run") == "B") | F.col("has_b").isNull())
    shape = M.classify_distribution(now, by).select(*by, "shape")
    g = now.groupBy(*by).agg(F.count("*").alias("n"), F.avg("result").alias("mu"), F.stddev_pop("result").alias("sd"))
    limits = df.groupBy(*by, "run").agg(F.min_by(F.struct("lo", "hi"), "id").alias("d"))
    limits = limits.groupBy(*by).agg(F.max_by("d", "run").alias("d")).select(*by, "d.lo", "d.hi")
    rec = df.groupBy(*by).agg(F.min_by("rec_type", F.struct("run", "id")).alias("rec_type"))
    comp = M.compare_distributions(df, by).select(*by, "z", "pct_shift", "differs", "shifted", "uncorrelated")
    site = M.site_dispersion(df.where("run = 'B'"), by).select(*by, "spread", "shift")
    _, _, cpk = M.capability(F.col("mu"), F.col("sd"), F.col("lo"), F.col("hi"), F.col("n"))
    x = reduce(lambda a, b: a.join(b, by, "left"), (rec, g, limits, comp, site, shape), status)
    named = reduce(lambda c, kv: c.when(F.col("shape") == kv[0], kv[1]), SHAPE_FLAG.items(), F.when(F.lit(False), ""))
    on = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    flags = F.array_compact(F.array(F.col("status"), on(F.col("shifted"), "shifted"), on(~F.col("differs"), "correlated"), on(F.col("uncorrelated"), "uncorrelated"), on(F.col("shift"), "site-shift"), on(F.col("rec_type") == "FTR", "functional"), named))
    return x.select(*by, "status", F.coalesce("shape", F.lit("sparse")).alias("shape"), flags.alias("flags"), F.round(cpk, 4).alias("cpk"), "z", "pct_shift", F.col("spread").alias("site_spread"))


def problems(a: DataFrame, name: str) -> DataFrame:
    """AU04, AU05, TK05: flagged tests in order of severity, each with its reason."""
    bad = F.arrays_overlap("flags", F.array(*map(F.lit, PROBLEMS))) | F.coalesce(F.col("cpk") < M.CPK, F.lit(False))
    has = lambda f: F.array_contains("flags", f)
    why = F.concat_ws(
        "; ",
        F.when(F.col("cpk") < M.CPK, F.concat(F.lit("Cpk "), F.format_number("cpk", 2), F.lit(" (below 1.33)"))),
        F.when(has("added"), "new test in this run"), F.when(has("removed"), "dropped since the last run"), F.when(has("changed"), "limits or test number changed"),
        F.when(has("shifted") & F.col("pct_shift").isNotNull(), F.concat(F.lit("mean moved "), F.format_string("%+.1f", F.col("pct_shift")), F.lit("%"))),
        F.when(has("uncorrelated"), "run-to-run correlation lost"), F.when(has("site-shift"), "site-to-site spread"),
        *(F.when(has(s), s.replace("-", " ")) for s in ("bimodal", "long-tail", "outliers")),
    )
    w = Window.orderBy(F.coalesce("cpk", F.lit(99.0)), F.desc(F.abs(F.coalesce("pct_shift", F.lit(0.0)))), name)  # one row for each test
    return a.where(bad).withColumn("place", F.row_number().over(w).cast("bigint")).select("place", name, "cpk", F.when(why == "", "flagged").otherwise(why).alias("reason"))


def interest(a: DataFrame) -> Column:
    """TK07."""
    has = lambda *f: F.arrays_overlap("flags", F.array(*map(F.lit, f)))
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.abs(F.coalesce(a["z"], F.lit(0.0))) + one(has("uncorrelated"), 3.0) + one(F.col("status").isin("added", "removed"), 1.5) + one(has("bimodal", "long-tail", "outliers"), 1.0)


def gallery(a: DataFrame, name: str, cap: int = 48) -> DataFrame:
    """TK06 over the nine categories; nothing flagged, the first tests."""
    f = a.withColumn("categories", F.array_join(F.array_intersect("flags", F.array(*map(F.lit, GALLERY))), ",")).withColumn("interest", F.round(interest(a), 6))
    return M.balanced_pick(f, name, F.col("interest"), cap, GALLERY)


def chip_filter(a: DataFrame, include: list[str], exclude: list[str], every: bool = False) -> DataFrame:
    """FLT20: rows with any (or every) included flag and no excluded one."""
    arr = lambda x: F.array(*map(F.lit, x))
    ok = F.lit(True)
    if include:
        ok = (F.size(F.array_except(arr(include), F.col("flags"))) == 0) if every else F.arrays_overlap("flags", arr(include))
    return a.where(ok & ~F.arrays_overlap("flags", arr(exclude)) if exclude else ok)


@F.pandas_udf(StringType())
def general(c: pd.Series) -> pd.Series:
    """A number as %g prints it, from its exact binary value. The JVM's formats round the shortest decimal instead, which differs in the last digit at ties."""
    return c.map(lambda v: f"{v:g}", na_action="ignore")


def test_text(r: DataFrame) -> Column:
    """TXT18: the chunk text of a test."""
    cond = F.transform(F.array_sort(F.map_entries(F.from_json("conditions", "map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(
        " ",
        F.when(F.coalesce("test_txt", F.lit("")) != "", F.col("test_txt")).otherwise(F.concat(F.lit("test "), F.col("test_num").cast("string"))),
        F.concat(F.lit("test "), F.col("test_num").cast("string")),
        F.when(F.col("result").isNotNull() & ~F.isnan("result"), F.concat(F.lit("result "), general(F.col("result")))),
        F.when(F.col("passed") == 1, "PASS").otherwise("FAIL"),
        F.concat(F.lit("part "), F.coalesce("part_id", F.lit("")), F.lit(" head "), F.col("head").cast("string"), F.lit(" site "), F.coalesce(F.col("site").cast("string"), F.lit(""))),
        F.when(F.size(cond) > 0, F.concat(F.lit("COND "), F.array_join(cond, " "))),
    )


def part_texts(parts: DataFrame, results: DataFrame) -> DataFrame:
    """TXT19: the chunk text of each touchdown with the number of its part's tests and how many passed."""
    n = results.groupBy("doc_id", "part_id").agg(F.count("*").alias("tests"), F.sum("passed").alias("good"))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    j = parts.join(n, ["doc_id", "part_id"], "left")
    text = F.concat_ws(" ", F.lit("part"), s("part_id"), F.lit("insertion"), s("insertion"), F.lit("wafer"), F.coalesce("wafer", F.lit("")), F.lit("x"), s("x"), F.lit("y"), s("y"), F.lit("bin"), s("hard_bin"), F.when(F.col("passed") == 1, "PASS").otherwise("FAIL"), F.coalesce("tests", F.lit(0)).cast("string"), F.lit("tests"), F.coalesce("good", F.lit(0)).cast("string"), F.lit("pass"))
    return j.select("id", "doc_id", text.alias("text"))


def payload(hits: DataFrame) -> DataFrame:
    """RK20: one row for each query: its hits in order and the documents they name, each once."""
    h = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "score")))
    return hits.groupBy("query_id").agg(h.alias("hits"), F.sort_array(F.collect_set(F.struct("doc_id", "path"))).alias("documents"))  # k hits


def mixed_formats(paths: DataFrame, formats: list[str]) -> DataFrame:
    """TXT31: a format for each path, in turn over the sorted paths. The order is total, so positions come from a sort by ranges and counts of its partitions,
    not from one window."""
    s = paths.orderBy("path").withColumn("__id", F.monotonically_increasing_id())
    s = s.withColumn("p", F.shiftright("__id", 33)).withColumn("i", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    n = s.groupBy("p").agg(F.count("*").alias("c"))
    base = n.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("base"))  # one row for each partition
    at = F.pmod(F.col("base") + F.col("i"), F.lit(len(formats)))
    return s.join(F.broadcast(base), "p").select("path", F.element_at(F.array(*map(F.lit, formats)), (at + 1).cast("int")).alias("format"))


def expires_at(written: Column, retain_days: int) -> Column:
    """SNK26: 12 hours or so many days later, rounded up to midnight; below 0, never."""
    if retain_days < 0:
        return F.lit(None).cast("timestamp")
    earliest = written + F.expr(f"INTERVAL {12 if retain_days == 0 else 24 * retain_days} HOURS")
    midnight = F.date_trunc("day", earliest)
    return F.when(midnight == earliest, midnight).otherwise(midnight + F.expr("INTERVAL 1 DAY"))


def reference_labels(hits: DataFrame) -> DataFrame:
    """RK25: "store — title — heading" of each cited chunk."""
    return hits.select("chunk_id", F.concat_ws(" — ", F.nullif("source", F.lit("")), F.coalesce("title", "path"), F.nullif(F.trim("locator"), F.lit(""))).alias("label"))
