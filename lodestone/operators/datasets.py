"""Tables as datasets: kinds of columns, wide and long readers, analysis of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.measure import capability
from lodestone.session import finite

#: Fixed tokens of a missing number.
MISSING = ("", "na", "n/a", "nan", "null", "none", "-", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity")
_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"


def as_float(c: Column) -> Column:
    """SRC28: a finite number or null. Digits may be grouped by single underscores."""
    t = F.trim(c)
    v = F.regexp_replace(t, "_", "").try_cast("double")
    return F.when(~F.lower(t).isin(*MISSING) & t.rlike(_NUMBER) & (F.abs(v) < float("inf")), v)


def missing(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*MISSING), F.lit(True))


def column_kinds(df: DataFrame) -> DataFrame:
    """SRC27: name, kind of each column of strings: numeric if 90 % of its cells that aren't missing are numbers, categorical if it has no more than
    max(20, n / 20) distinct values, else text. One pass over all columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("cell")) for c in df.columns))).alias("s")).select("s.*")
    g = long.where(~missing(F.col("cell"))).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.when(as_float(F.col("cell")).isNotNull(), 1).otherwise(0)).alias("numbers"), F.count_distinct(F.trim("cell")).alias("values"))
    kind = F.when(F.col("numbers") >= 0.9 * F.col("n"), "numeric").when(F.col("values") <= F.greatest(F.lit(20.0), F.col("n") / 20), "categorical").otherwise("text")
    return g.select("name", kind.alias("kind"), "n", "values")


def unique_names(names: list[str]) -> list[str]:
    """SRC24: a repeated header gets _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_wide(df: DataFrame, row: str, numeric: list[str], group: str | None = None) -> DataFrame:
    """SRC26, D10: name, row_idx (among kept values), src_row, value, grp."""
    long = df.select(F.col(row).alias("src_row"), (F.col(group) if group else F.lit(None).cast("string")).alias("grp"), *(F.col(c).cast("string").alias(c) for c in numeric)).unpivot(["src_row", "grp"], numeric, "name", "cell")
    kept = long.withColumn("value", as_float(F.col("cell"))).where("value IS NOT NULL")
    w = Window.partitionBy("name").orderBy("src_row")
    return kept.select("name", (F.row_number().over(w) - 1).alias("row_idx"), "src_row", "value", "grp")


def read_long(df: DataFrame, row: str, label: str, value: str, lo: str | None = None, hi: str | None = None, units: str | None = None) -> DataFrame:
    """SRC25: rows without label or number are dropped; limits and units come from a label's first valid row."""
    col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    d = df.select(F.col(row).alias("src_row"), F.trim(F.col(label)).alias("name"), as_float(F.col(value).cast("string")).alias("value"), as_float(col(lo)).alias("lo"), as_float(col(hi)).alias("hi"), col(units).alias("units"))
    d = d.where("name <> '' AND value IS NOT NULL")
    w = Window.partitionBy("name").orderBy("src_row")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.select("name", (F.row_number().over(w) - 1).alias("row_idx"), "value", first("lo").alias("lo"), first("hi").alias("hi"), first("units").alias("units"))


def split_fixed(line: Column, widths: list[int]) -> Column:
    """SRC23: one field for each width; a field that isn't whole inside the line is empty."""
    out, at = [], 0
    for w in widths:
        out.append(F.when(F.length(line) >= at + w, F.trim(F.substring(line, at + 1, w))).otherwise(""))
        at += w
    return F.array(*out)


def column_analysis(columns: DataFrame, values: DataFrame, by_group: bool = False) -> DataFrame:
    """AG37, AG38: statistics and capability of each numeric column, by group if asked."""
    v = values.dropDuplicates(["col_id", "row_idx"]).where(finite(F.col("value")))
    by = ["col_id", *(["grp"] if by_group else [])]
    g = v.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mu"), F.percentile("value", 0.5).alias("median"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    c = columns.dropDuplicates(["id"]).select(F.col("id").alias("col_id"), "name", "lo", "hi")
    g = g.join(c, "col_id")
    num = lambda x: F.when(~F.isnan(x), F.col(x))
    _, _, cpk = capability(F.col("mu"), F.col("sd"), num("lo"), num("hi"), F.col("n"))
    return g.select(*by, "name", "n", "mu", "median", "sd", "min", "max", cpk.alias("cpk"))
