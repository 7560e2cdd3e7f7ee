"""Catalog entries and look-ups: chunk texts of tables and symbols, pictures, filters by pattern, maps, plot data, lenient conversions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import finite, ship
from lodestone.sources.documents import Node, _simple, _Tree

# Fixed values of the selector proposal: candidates for the content, tags that are always frame, words of ids and classes of frames.
CONTENT_CANDIDATES = ("main", "article", "[role=main]", "[role=article]", "div.body", "div.content", "div#content", "div#main", "div.markdown-body", "div.wh_topic_content", "section.content", "div.document")
FRAME_TAGS = ("script", "style", "nav", "header", "footer", "aside")
FRAME_WORDS = ("nav", "breadcrumb", "crumb", "footer", "header", "sidebar", "toc", "menu", "banner", "prevnext", "pagination")


def summary_chunks(columns: DataFrame, values: DataFrame) -> DataFrame:
    """SNK21, TXT20: one summary chunk for each dataset: its columns in order of their ids, the numeric ones with the number of their values. doc_id, dataset, text."""
    n = values.dropDuplicates(["col_id", "row_idx"]).groupBy(F.col("col_id").alias("id")).agg(F.count("*").alias("values"))
    c = columns.dropDuplicates(["id"]).join(n, "id", "left")
    label = F.concat("name", F.lit(" ("), "kind", F.when(F.col("kind") == "numeric", F.concat(F.lit(", "), F.coalesce("values", F.lit(0)).cast("string"))).otherwise(""), F.lit(")"))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", label.alias("l")))), lambda x: x["l"]), ", ")  # the columns of one table
    return c.groupBy("doc_id", "dataset").agg(F.concat(F.lit("Dataset "), F.first("dataset"), F.lit(": "), parts).alias("text"))


def symbol_text(kind: Column, qualname: Column, signature: Column, docstring: Column, path: Column) -> Column:
    """TXT20: the chunk text of a symbol."""
    return F.concat_ws("\n", F.concat_ws(" ", kind, qualname), F.nullif(signature, F.lit("")), F.nullif(docstring, F.lit("")), path)


def stage_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK09, SNK23: (one row for each content, the image_ref chunks). images(doc_id, locator, content, alt, caption, src); a picture without content counts as unresolved and has only its chunk."""
    x = images.withColumn("sha256", F.when(F.col("content").isNotNull(), F.sha2("content", 256)))
    unique = x.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("doc_id", "locator", "alt")).alias("f"), F.count("*").alias("uses")).select("sha256", "f.*", "uses")
    refs = x.select("doc_id", "locator", F.lit("image_ref").alias("kind"), F.concat_ws(" ", F.nullif("alt", F.lit("")), F.nullif("caption", F.lit("")), "src").alias("text"), "sha256")
    return unique, refs


def with_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    """JN03, JN04, RK11, RK24: hits(doc_id, locator, ...) with the pictures of their section, each once, in order."""
    own = images.groupBy("doc_id", "locator").agg(F.sort_array(F.collect_set("sha256")).alias("images"))  # the pictures of one section
    return hits.join(own, ["doc_id", "locator"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def restore(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN21: what was known under a content's key comes back for rows that lack it."""
    o = old.select(key, *(F.col(c).alias(f"__{c}") for c in columns)).dropDuplicates([key])
    j = new.join(o, key, "left")
    return j.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in new.columns))


def first_bodies(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN15: each picture with the first enrichment text of its document."""
    b = chunks.where("kind = 'enrichment'").groupBy(F.col("document_id").alias("doc_id")).agg(F.min_by("text", "id").alias("body"))
    return images.join(b, "doc_id", "left")


def like_name(symbols: DataFrame, pattern: str, **equal: str) -> DataFrame:
    """FLT07: name or qualified name like a pattern in any case, other columns equal where given."""
    d = symbols.where(F.ilike("name", F.lit(pattern)) | F.ilike("qualname", F.lit(pattern)))
    for c, v in equal.items():
        d = d.where(F.col(c) == v)
    return d


def raw_records(records: DataFrame, doc: int | None = None, kind: str | None = None) -> DataFrame:
    """FLT08: by document and record type in any case."""
    d = records if doc is None else records.where(F.col("doc_id") == doc)
    return d if kind is None else d.where(F.upper("rec_type") == kind.upper())


def fnmatch(pattern: str) -> str:
    """FLT09-FLT11: a shell pattern over the whole text as a regular expression, any case."""
    out = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(".*" if ch == "*" else "." if ch == "?" else re.escape(ch))
        i += 1
    return "(?is)^" + "".join(out) + "$"


def matching_columns(columns: DataFrame, pattern: str) -> DataFrame:
    """FLT11, FLT19: numeric columns whose name, or dataset.name, matches."""
    p = fnmatch(pattern)
    return columns.where((F.col("kind") == "numeric") & (F.col("name").rlike(p) | F.concat_ws(".", "dataset", "name").rlike(p)))


def site_groups(results: DataFrame, by: list[str]) -> DataFrame:
    """AG14, AU11: the values of each group as figures of a box plot, not as lists: n, minimum, quartiles, maximum."""
    q = F.percentile("result", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    g = results.where(finite(F.col("result"))).groupBy(*by).agg(F.count("*").alias("n"), F.min("result").alias("low"), q.alias("q"), F.max("result").alias("high"))
    return g.select(*by, "n", "low", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "high")


#: Values of a test that a plot may take.
PLOT_VALUES = 20_000


def value_sample(results: DataFrame, by: list[str], n: int) -> DataFrame:
    """TK09, D15: the first n values of each group by id, for scatter and line plots."""
    w = Window.partitionBy(*by).orderBy("id")
    return results.where(finite(F.col("result"))).withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)


def qq_points(df: DataFrame, by: list[str], n: int = 21, run: str = "run", a: str = "A", b: str = "B") -> DataFrame:
    """AU16: matched quantiles of two runs."""
    ps = F.array(*(F.lit(i / (n - 1)) for i in range(n)))
    q = lambda r: F.percentile(F.when(F.col(run) == r, F.col("result")), ps)
    g = df.where(finite(F.col("result"))).groupBy(*by).agg(q(a).alias("a"), q(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return g.select(*by, F.posexplode(F.arrays_zip("a", "b")).alias("i", "p")).select(*by, "i", F.round("p.a", 4).alias("x"), F.round("p.b", 4).alias("y"))


def as_int(c: Column) -> Column:
    """FN01, FN06: an integer out of text or a number, fractions cut off; else null."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.abs(d) < 9.2e18, F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).try_cast("bigint"))


def as_list(c: Column) -> Column:
    """FN03: null is the empty list."""
    return F.when(c.isNull(), F.array()).otherwise(F.array(c))


def plain(c: Column) -> Column:
    """FN04: bytes as hexadecimal text."""
    return F.lower(F.hex(c))


def vector_bytes(c: Column) -> Column:
    """TXT27: a vector as little-endian 32-bit floats."""
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")

    return run(c)


def vector_of(c: Column) -> Column:
    """TXT27: the other way round."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.pandas_udf(ArrayType(FloatType()))
    def run(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: np.frombuffer(x, "<f4"), na_action="ignore")

    return run(c)


def approved_rules(text: str) -> list[tuple[str, str]]:
    """TXT09, MS24: (pattern, label) of a JSON rule file, none unless ``approved`` is exactly true and all is well formed."""
    try:
        d = json.loads(text)
        if d["approved"] is not True:
            return []
        return [(str(r["pattern"]), str(r["label"])) for r in d["gotcha_patterns"]]
    except (ValueError, KeyError, TypeError):
        return []


def reply_json(c: Column) -> Column:
    """MS27: the text between the outermost braces of a model's reply, null if it isn't JSON."""
    body = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.get_json_object(body, "$").isNotNull(), body)


def searchable(description: Column, ocr: Column) -> Column:
    """MS28."""
    return F.concat_ws("\n\n", F.nullif(F.trim(description), F.lit("")), F.nullif(F.trim(ocr), F.lit("")))


def chosen_stores(df: DataFrame, names: list[str] | None, known: list[str]) -> DataFrame:
    """RK10: rows of the named stores; an unknown name is an error."""
    if names is None:
        return df
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"no such store: {', '.join(unknown)}")
    return df.where(F.col("store").isin(names))


def batch_top_k(k: int, queries: int) -> int:
    """TK14."""
    return min(k, 5) if queries > 4 else k


def propose_selectors(pages: DataFrame) -> DataFrame:
    """TXT25: how many pages each selector matches and how much of their text the content candidates hold: selector, role, pages, share, coverage, proposed. The best content candidate
    (in 60 % of pages at least, with 40 % of the text) and frame selectors in 30 % of pages are proposed. pages(html)."""

    def size(n: Node) -> int:
        return len(" ".join(n.text().split()))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for html in pdf["html"]:
                t = _Tree()
                t.feed(html or "")
                nodes = list(t.root.all())
                whole = max(1, size(next((n for n in nodes if n.tag == "body"), t.root)))
                rows.append(("", "all", 1.0))
                for s in CONTENT_CANDIDATES:
                    hit = next(filter(_simple(s), nodes), None)
                    if hit is not None:
                        rows.append((s, "content", size(hit) / whole))
                frame = {n.tag for n in nodes if n.tag in FRAME_TAGS}
                for n in nodes:
                    id_, cls = n.attrs.get("id", ""), n.attrs.get("class", "")
                    if any(w in f"{id_} {cls}".lower() for w in FRAME_WORDS):
                        frame.add(f"#{id_}" if id_ else "." + cls.split()[0])
                rows += [(s, "frame", 1.0) for s in sorted(frame)]
            yield pd.DataFrame(rows, columns=["selector", "role", "coverage"])

    ship(pages.sparkSession)
    f = pages.select("html").mapInPandas(run, "selector string, role string, coverage double").groupBy("selector", "role").agg(F.count("*").alias("pages"), F.avg("coverage").alias("coverage"))
    n = F.max(F.when(F.col("role") == "all", F.col("pages"))).over(Window.partitionBy(F.lit(0)))  # one row for each selector
    f = f.withColumn("n", n).withColumn("share", F.col("pages") / F.col("n")).where("role <> 'all'")
    w = Window.partitionBy("role").orderBy(F.desc(F.round("share", 2)), F.desc(F.round(F.least("coverage", F.lit(0.97)), 2)), F.array_position(F.lit(list(CONTENT_CANDIDATES)), F.col("selector")), "selector")
    f = f.withColumn("place", F.row_number().over(w))
    good = F.when(F.col("role") == "content", (F.col("place") == 1) & (F.col("share") >= 0.6) & (F.col("coverage") >= 0.4)).otherwise(F.col("pages") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.3)))
    return f.select("selector", "role", "pages", F.round("share", 4).alias("share"), F.round("coverage", 4).alias("coverage"), good.alias("proposed"))


def test_chunks(results: DataFrame, parts: DataFrame, granularity: str = "both") -> DataFrame:
    """SNK19: the chunks of logs: one for each test result, one for each touchdown, or both; results come first."""
    from lodestone.operators import reports as R

    t = results.select("doc_id", F.lit(0).alias("__kind"), "id", F.lit("test").alias("kind"), R.test_text(results).alias("text"))
    p = R.part_texts(parts, results).select("doc_id", F.lit(1).alias("__kind"), "id", F.lit("part").alias("kind"), "text")
    both = t if granularity == "test" else p if granularity == "part" else t.unionByName(p)
    w = Window.partitionBy("doc_id").orderBy("__kind", "id")
    return both.select("doc_id", (F.row_number().over(w) - 1).alias("ord"), "kind", "text")


def condition_flags(results: DataFrame) -> DataFrame:
    """SNK19: a flag for each document and condition."""
    c = results.where("conditions IS NOT NULL").select("doc_id", F.explode(F.from_json("conditions", "map<string,string>")).alias("k", "v"))
    return c.distinct().select("doc_id", F.lit("condition").alias("kind"), F.concat_ws("=", "k", "v").alias("note"))


def unembedded(chunks: DataFrame, vectors: DataFrame, embed, model: str, dim: int) -> DataFrame:
    """RK21: vectors of the chunks that have none. ``embed`` is a column function of the registry."""
    todo = chunks.select(F.col("id").alias("chunk_id"), "text").join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    return todo.select("chunk_id", F.lit(model).alias("model"), F.lit(dim).alias("dim"), embed(F.col("text")).alias("vector"))
