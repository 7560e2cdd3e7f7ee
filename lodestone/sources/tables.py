"""Delimited and fixed-width text as datasets (SRC21-SRC26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import datasets as D

# Delimiters by suffix and by name.
BY_SUFFIX = {"csv": ",", "tsv": "\t", "tab": "\t", "psv": "|"}
BY_NAME = {"tab": "\t", "space": " ", "pipe": "|", "semicolon": ";", "comma": ","}


def delimiter(path: str, given: str | None = None) -> str:
    """SRC22: a given one by name or as it is, else by suffix, else a comma."""
    if given:
        return BY_NAME.get(given.lower(), given)
    return BY_SUFFIX.get(path.rpartition(".")[2].lower(), ",")


def read_table(spark: SparkSession, path: str, given: str | None = None, widths: list[int] | None = None) -> DataFrame:
    """SRC21, SRC23, SRC24: all columns as text, plus ``src_row`` (from 0, in file order; blank lines don't count). The header's repeated names get
    numbers; short rows are filled with nulls. One file; its rows are numbered by the offset of their partition, so a large file is read in parallel."""
    if widths:
        lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
        first = lines.first()
        if first is None:
            return spark.createDataFrame([], "src_row bigint")
        fields = lines.select(D.split_fixed(F.col("line"), widths).alias("f"), F.monotonically_increasing_id().alias("__id"))
        head = fields.orderBy("__id").first()
        names = D.unique_names([n or f"column_{i + 1}" for i, n in enumerate(head["f"])])
        body = _numbered(fields, "__id").where("src_row > 0")
        return body.select((F.col("src_row") - 1).alias("src_row"), *(F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
    sep = delimiter(path, given)
    raw = spark.read.option("sep", sep).option("header", "false").option("mode", "PERMISSIVE").option("multiLine", "true" if _quoted_breaks(spark, path) else "false")
    head = spark.read.text(path).where(F.trim("value") != "").first()
    if head is None:
        return spark.createDataFrame([], "src_row bigint")
    parsed = spark.createDataFrame([(head[0].removeprefix("﻿"),)], "line string").select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(head[0].count(sep) + 1)), {"sep": sep})).first()[0]
    names = D.unique_names([(n or f"column_{i + 1}").strip() for i, n in enumerate(parsed) if n is not None or i == 0 or any(x is not None for x in parsed[i:])])
    df = raw.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    filled = F.lit(False)
    for n in names:
        filled = filled | (F.trim(F.coalesce(F.col(f"`{n}`"), F.lit(""))) != "")
    df = _numbered(df.where(filled).withColumn("__id", F.monotonically_increasing_id()), "__id").where("src_row > 0")
    return df.select((F.col("src_row") - 1).alias("src_row"), *(F.col(f"`{n}`") for n in names))


def _quoted_breaks(spark: SparkSession, path: str) -> bool:
    """A line with an odd number of quotes means that a field holds a line break."""
    odd = F.pmod(F.length("value") - F.length(F.regexp_replace("value", '"', "")), F.lit(2)) == 1
    return spark.read.text(path).where(odd).limit(1).count() > 0


def _numbered(df: DataFrame, id_: str) -> DataFrame:
    """src_row from the ids of monotonically_increasing_id: the rows before a row's partition plus its place in it. One row for each partition is summed up."""
    p, i = F.shiftright(id_, 33), F.col(id_).bitwiseAND(F.lit((1 << 33) - 1))
    x = df.withColumn("__p", p).withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(i)) - 1)
    n = x.groupBy("__p").agg(F.count("*").alias("c"))
    base = n.select("__p", (F.sum("c").over(Window.orderBy("__p")) - F.col("c")).alias("__base"))
    return x.join(base, "__p").withColumn("src_row", F.col("__base") + F.col("__i")).drop("__p", "__i", "__base", id_)


def read_dataset(spark: SparkSession, path: str, group: str | None = None, label: str | None = None, value: str | None = None, **kw) -> DataFrame:
    """SRC24: the long reader if label and value columns are named, else all numeric columns unpivoted."""
    df = read_table(spark, path, **kw)
    if label and value:
        return D.read_long(df, "src_row", label, value)
    kinds = {r["name"]: r["kind"] for r in D.column_kinds(df.drop("src_row")).collect()}  # one row for each column
    numeric = [c for c in df.columns if c not in ("src_row", group) and kinds.get(c) == "numeric"]
    return D.read_wide(df, "src_row", numeric, group)
