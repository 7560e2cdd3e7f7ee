"""Touchdowns: yields, retests, traces, wafer and lot roll-ups, die grids. A touchdown's order is its id; repeated rows of an id count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SPAN = 1024


def touchdowns(parts: DataFrame) -> DataFrame:
    """Each id once, insertions in one spelling."""
    return parts.dropDuplicates(["id"]).withColumn("insertion", F.regexp_replace(F.lower(F.trim(F.coalesce("insertion", F.lit("")))), r"[\s_-]+", " "))


def part_key(fields: list[str], fallback: str = "part_id") -> Column:
    """WN12, FN08: the chosen fields as text; all blank, the part id."""
    values = [F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    key = F.concat_ws("|", *values)
    blank = values[0] == ""
    for v in values[1:]:
        blank = blank & (v == "")
    return F.when(blank, F.coalesce(fallback, F.lit(""))).otherwise(key)


def part_summary(parts: DataFrame) -> DataFrame:
    """AG10, AG27: touchdowns, those of bin 1, mean times where there is a time."""
    t = F.when(F.col("test_time_ms") > 0, F.col("test_time_ms"))
    first = F.col("hard_bin") == 1
    return parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.count(F.when(first, 1)).alias("bin1"), F.round(F.avg(t), 4).alias("mean_ms"), F.round(F.avg(F.when(first, t)), 4).alias("mean_ms_bin1"))


def part_yield(results: DataFrame) -> DataFrame:
    """AG21: a part passes if all its tests do; rows without part id don't count."""
    p = results.where("trim(coalesce(part_id, '')) <> ''").groupBy("doc_id", "part_id").agg(F.min("passed").alias("ok"))
    return p.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("ok") == 1, 1).otherwise(0)).alias("good"), F.round(F.avg(F.when(F.col("ok") == 1, 1.0).otherwise(0.0)), 6).alias("yield"))


def insertion_yield(parts: DataFrame, fields: list[str]) -> DataFrame:
    """AG22, WN03: by insertion in order of appearance: units, first-pass and final yield, retested units."""
    u = parts.withColumn("key", part_key(fields)).groupBy("insertion", "key").agg(F.min_by("passed", "id").alias("first"), F.max_by("passed", "id").alias("last"), F.count("*").alias("touches"), F.min("id").alias("seen"))
    g = u.groupBy("insertion").agg(F.count("*").alias("units"), F.sum("first").alias("first_pass"), F.sum("last").alias("final_pass"), F.sum(F.when(F.col("touches") > 1, 1).otherwise(0)).alias("retested"), F.min("seen").alias("seen"))
    w = Window.orderBy("seen")  # one row for each insertion
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).select("insertion", "place", "units", "first_pass", "final_pass", "retested", F.round(F.col("first_pass") / F.col("units"), 6).alias("first_yield"), F.round(F.col("final_pass") / F.col("units"), 6).alias("final_yield"))


def trace_matrix(parts: DataFrame, fields: list[str], insertions: list[str]) -> DataFrame:
    """WN04: last result of each unit at each insertion (1, 0 or null), a column for each."""
    last = parts.withColumn("key", part_key(fields)).groupBy("key", "insertion").agg(F.max_by("passed", "id").alias("passed"))
    p = last.groupBy("key").pivot("insertion", insertions).agg(F.max("passed"))
    return p.select("key", *(F.col(f"`{i}`").alias(i.replace(" ", "_")) for i in insertions))


def mapped(parts: DataFrame) -> DataFrame:
    """FLT15."""
    return parts.where("x IS NOT NULL AND y IS NOT NULL")


def wafer_rollup(parts: DataFrame, by: list[str]) -> DataFrame:
    """AG23: dies, passes, extent and yield of each wafer, over mapped dies."""
    return mapped(parts).groupBy(*by).agg(
        F.count("*").alias("dies"), F.sum("passed").alias("passed"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.round(F.sum("passed") / F.count("*"), 6).alias("yield"),
    )


def mother_lot(parts: DataFrame) -> DataFrame:
    """AG24: pooled yield of each lot and its worst wafer (the first name of ties)."""
    w = wafer_rollup(parts.where("trim(coalesce(wafer, '')) <> ''"), ["lot", "wafer"])
    worst = F.min_by("wafer", F.struct("yield", "wafer"))
    return w.groupBy("lot").agg(F.count("*").alias("wafers"), F.sum("dies").alias("dies"), F.sum("passed").alias("passed"), F.round(F.sum("passed") / F.sum("dies"), 6).alias("yield"), worst.alias("worst_wafer"), F.min("yield").alias("worst_yield"))


def production_trend(parts: DataFrame) -> DataFrame:
    """AG25, D16: yield of each log over its mapped dies, from exact counts; the label is its first lot."""
    g = mapped(parts).groupBy("doc_id").agg(F.min_by("lot", "id").alias("lot"), F.count("*").alias("dies"), F.sum("passed").alias("passed"))
    return g.select("doc_id", F.coalesce("lot", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("label"), "dies", "passed", F.round(F.col("passed") / F.col("dies"), 6).alias("yield"))


def die_grid(parts: DataFrame, by: list[str]) -> DataFrame:
    """AU12: grid position of the last touchdown of each die and the index of its soft bin among the wafer's; wafers wider than 1024 are left out."""
    last = mapped(parts).groupBy(*by, "x", "y").agg(F.max_by(F.struct("soft_bin", "passed"), "id").alias("d"))
    w = Window.partitionBy(*by)
    g = last.select(*by, "x", "y", "d.*").withColumn("x0", F.min("x").over(w)).withColumn("y0", F.min("y").over(w))
    g = g.withColumn("span", F.greatest(F.max("x").over(w) - F.col("x0"), F.max("y").over(w) - F.col("y0"))).where(F.col("span") < MAX_SPAN)
    return g.select(*by, (F.col("x") - F.col("x0") + 1).alias("col"), (F.col("y") - F.col("y0") + 1).alias("row"), "soft_bin", (F.dense_rank().over(w.orderBy("soft_bin")) - 1).alias("color"), "passed")


def parametric_map(parts: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """AU13, JN18, D21: the last value of each die, scaled to 0..1 over the wafer. values(doc_id, part_id, id, result)."""
    pos = mapped(parts).where("trim(coalesce(part_id, '')) <> ''").groupBy("doc_id", "part_id", *[c for c in by if c != "doc_id"]).agg(F.max_by(F.struct("x", "y"), "id").alias("p"))
    v = values.groupBy("doc_id", "part_id").agg(F.max_by("result", "id").alias("v"))
    j = pos.join(v, ["doc_id", "part_id"]).select(*by, "part_id", "p.x", "p.y", "v")
    w = Window.partitionBy(*by)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    t = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - lo) / (hi - lo)))).otherwise(0.5)
    return j.select(*by, "part_id", "x", "y", F.round(t, 6).alias("t"))


def heat(t: Column) -> Column:
    """Three-stop colour of 0..1 as #rrggbb: blue, white, red."""
    up = F.when(t < 0.5, t * 2).otherwise(1.0)
    down = F.when(t > 0.5, (1 - t) * 2).otherwise(1.0)
    two = lambda c: F.lpad(F.lower(F.hex(F.round(c * 255).cast("bigint"))), 2, "0")
    return F.concat(F.lit("#"), two(up), two(F.least(up, down)), two(down))
