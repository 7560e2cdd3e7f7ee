"""Folds over raw record streams, as windows: sticky conditions, static inheritance, part assignment.

Input: records(run, ord, rec_type, ...) in file order. Everything is partitioned by run; a run is one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The built-in rules in their order, (pattern, action); the first group is the key to clear or the pairs to set.
CLEAR_RULE, SET_RULE = r"^\s*COND_OFF\b\s*:?\s*(\S*)\s*$", r"^\s*COND:\s*(.+?)\s*$"
RULES = ((CLEAR_RULE, "clear"), (SET_RULE, "set"))


def assign_parts(records: DataFrame) -> DataFrame:
    """WN09, D19: head and site of an open part decide; each test belongs to the next closing record of its head and site; tests behind the last have part ''. A blank part id is the ordinal of the part's opening record."""
    head = Window.partitionBy("run", "head", "site").orderBy("ord")
    r = records.withColumn("opened", F.sum(F.when(F.col("rec_type") == "PIR", 1).otherwise(0)).over(Window.partitionBy("run").orderBy("ord")))
    named = F.when(F.trim(F.coalesce("part_id", F.lit(""))) != "", F.col("part_id"))
    closing = F.when(F.col("rec_type") == "PRR", F.struct(named.alias("id"), F.col("ord").alias("at")))
    r = r.withColumn("close", F.first(closing, ignorenulls=True).over(head.rowsBetween(0, Window.unboundedFollowing)))
    own = F.last(F.when(F.col("rec_type") == "PIR", F.col("opened")), ignorenulls=True).over(head)
    return r.withColumn("part", F.when(F.col("close").isNull(), "").otherwise(F.coalesce("close.id", own.cast("string")))).drop("opened", "close")


def carry(records: DataFrame, column: str, rec_type: str) -> DataFrame:
    """WN10: the last value seen in records of a type so far."""
    w = Window.partitionBy("run").orderBy("ord")
    return records.withColumn(column, F.last(F.when(F.col("rec_type") == rec_type, F.col(column)), ignorenulls=True).over(w))


def inherit_static(tests: DataFrame) -> DataFrame:
    """WN06: limits of a test as its record states them, else from the first record of the same number in the run. opt_flag bits: 0x40 no low
    limit, 0x10 low limit inherited, 0x80 no high, 0x20 high inherited; no flags, inherited where missing."""
    w = Window.partitionBy("run", "test_num").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(F.struct("test_txt", "units", "lo", "hi")).over(w)
    t = tests.withColumn("f", first)
    bit = lambda b: F.col("opt_flag").bitwiseAND(F.lit(b)) != 0

    def limit(c: str, none: int, inherited: int):
        return F.when(F.col("opt_flag").isNull(), F.coalesce(c, f"f.{c}")).when(bit(none), F.lit(None)).when(bit(inherited), F.col(f"f.{c}")).otherwise(F.col(c))

    blank = lambda c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"f.{c}"))
    return t.select("run", "ord", "test_num", blank("test_txt").alias("test_txt"), blank("units").alias("units"), limit("lo", 0x40, 0x10).alias("lo"), limit("hi", 0x80, 0x20).alias("hi"))


def sticky_conditions(records: DataFrame, part_scope: bool = True, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """WN07, WN08, UD05: the conditions in force at each test: run, ord, cond (map). The first of ``rules`` that a text record matches applies: it sets
    "K=V, K2=V2" pairs, or clears one key, or ("*" or nothing) all; with ``part_scope`` the end of a part clears all.
    The last event of each key before a test decides, by one window for each run and key."""
    text = F.coalesce("text", F.lit(""))
    action, body = None, None
    for pattern, kind in rules:
        hit = text.rlike(pattern)
        action = F.when(hit, kind) if action is None else action.when(hit, kind)
        own = F.regexp_extract(text, pattern, 1)
        body = F.when(hit, own) if body is None else body.when(hit, own)
    r = records.select("run", "ord", "rec_type", F.when(F.col("rec_type") == "DTR", action).alias("action"), F.trim(body).alias("body")).distinct()  # a pin list has several rows of one record
    wipe = (F.col("action") == "clear") & F.col("body").isin("", "*")
    if part_scope:
        wipe = F.coalesce(wipe, F.lit(False)) | (F.col("rec_type") == "PRR")
    state = lambda v: F.struct(v.alias("v"))
    sets = r.where("action = 'set'").select("run", "ord", F.posexplode(F.split("body", ",")).alias("at", "pair")).where("instr(pair, '=') > 0")
    sets = sets.select("run", "ord", "at", F.trim(F.substring_index("pair", "=", 1)).alias("k"), F.trim(F.expr("substring(pair, instr(pair, '=') + 1)")).alias("v")).where("k <> ''").groupBy("run", "ord", "k").agg(F.max_by("v", "at").alias("v"))
    sets = sets.select("run", "ord", "k", F.lit(False).alias("test"), state(F.col("v")).alias("event"))
    clears = r.where((F.col("action") == "clear") & ~wipe).select("run", "ord", F.col("body").alias("k"), F.lit(False).alias("test"), state(F.lit(None).cast("string")).alias("event"))
    tests = r.where(F.col("rec_type").isin("PTR", "FTR", "MPR")).select("run", "ord")
    keys = sets.select("run", "k").distinct()  # few for each run
    every = tests.select("run", "ord", F.lit(True).alias("test"), F.lit(None).cast("struct<v:string>").alias("event")).unionByName(r.where(wipe).select("run", "ord", F.lit(False).alias("test"), state(F.lit(None).cast("string")).alias("event")))
    every = every.join(keys, "run").select("run", "ord", "k", "test", "event").unionByName(sets).unionByName(clears)
    last = F.last("event", ignorenulls=True).over(Window.partitionBy("run", "k").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = every.withColumn("now", last).where(F.col("test") & F.col("now.v").isNotNull())
    held = held.groupBy("run", "ord").agg(F.sort_array(F.collect_list(F.struct("k", "now.v"))).alias("c"))
    return tests.join(held, ["run", "ord"], "left").select("run", "ord", F.map_from_entries(F.coalesce("c", F.array().cast("array<struct<k:string,v:string>>"))).alias("cond"))


def condition_sets(results: DataFrame, by: list[str], column: str = "conditions") -> DataFrame:
    """AG36: distinct (key, value) of the condition maps of each group."""
    m = results.where(F.col(column).isNotNull()).select(*by, F.explode(F.from_json(column, "map<string,string>")).alias("k", "v"))
    return m.distinct()


def condition_diff(sets: DataFrame, run: str, a: str, b: str) -> DataFrame:
    """SET03, SET04: conditions in one run only."""
    x, y = (sets.where(F.col(run) == r).select("k", "v").distinct() for r in (a, b))
    only = lambda p, q, name: p.join(q, ["k", "v"], "left_anti").withColumn("only_in", F.lit(name))
    return only(x, y, a).unionByName(only(y, x, b))
