"""Chunking, rules, duplicates, maintenance and audits of a catalog of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import ship

CHUNK_WORDS, OVERLAP = 350, 40


def word_chunks(segments: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """TXT02, WN13: document_id, ord, kind, locator, text. Words of adjacent segments with one heading path are packed into windows of ``size`` words that
    share ``overlap``; code is never cut and closes its group; a last window is made only for words that no other holds. Segments without words give nothing."""
    v = min(max(overlap, 0), max(size - 1, 0))
    step = size - v
    w = Window.partitionBy("document_id").orderBy("ord")
    code = F.col("kind") == "code"
    starts = code | F.coalesce(F.lag(code).over(w), F.lit(True)) | ~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(w))
    s = segments.withColumn("g", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    words = F.filter(F.split(T.clean(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    parts = F.sort_array(F.collect_list(F.struct("ord", "words")))
    s = s.withColumn("words", words).groupBy("document_id", "g", F.when(code, "code").otherwise("body").alias("kind"), F.col("heading_path").alias("locator")).agg(F.flatten(F.transform(parts, lambda p: p["words"])).alias("words"), F.min("ord").alias("first"), F.max(F.when(code, F.col("text"))).alias("code"))
    n = F.size("words")
    k = F.when(n >= size, F.floor((n - size) / F.lit(step)) + 1).otherwise(0)
    rest = F.when(k == 0, n).otherwise(n - ((k - 1) * step + size))
    count = F.when(F.col("kind") == "code", F.when(n > 0, 1).otherwise(0)).otherwise(k + F.when(rest > 0, 1).otherwise(0)).cast("int")
    s = s.withColumn("count", count).where("count > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    text = F.when(F.col("kind") == "code", F.col("code")).otherwise(F.array_join(F.slice("words", F.col("i") * step + 1, F.lit(size)), " "))
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("first", "i")) - 1
    return s.select("document_id", at.alias("ord"), "kind", "locator", text.alias("text"))


def rule_flags(chunks: DataFrame, rules: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """TXT06, TXT07: tagged text and label of chunks that a rule matches."""
    label = T.first_rule(F.col("text"), rules)
    return chunks.withColumn("label", label).where("label IS NOT NULL").select(key, "label", T.tagged(F.col("text")).alias("text"))


def ingest_text(chunks: DataFrame) -> DataFrame:
    """TXT28: a document's chunks in order, joined by line breaks; pictures and enrichments left out."""
    own = chunks.where(~F.col("kind").isin("enrichment", "image_ref"))
    parts = F.sort_array(F.collect_list(F.struct("ord", "id", F.coalesce("text", F.lit("")).alias("text"))))  # one document's text
    return own.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def duplicate_groups(documents: DataFrame) -> DataFrame:
    """AG19, JN11: content hashes of two or more active documents: members, the smallest id, the number of sources."""
    d = documents.where("status = 'active' AND coalesce(content_hash, '') <> ''")
    return d.groupBy("content_hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("source").alias("sources")).where("members >= 2")


def changed(listing: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """FLT01, ST01: files whose (path, hash) isn't known."""
    return listing if force else listing.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def orphans(known: DataFrame, listing: DataFrame) -> DataFrame:
    """FLT16: known documents whose path is gone."""
    return known.join(listing.select("path"), "path", "left_anti")


def without(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """FLT17, FLT18, JN08-JN10: worklists: rows of one table that another has nothing for."""
    return left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """SNK10, SNK11, SNK15: the newest row of each key; rows of ``new`` win over those of ``old``."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.col(order).desc() if isinstance(order, str) else order)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__new", "__rn")


def cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """SNK14, D2: each table without the rows of the documents ``ids`` (doc_id). A table is given with its column of document ids."""
    return {n: df.join(ids.select(F.col("doc_id").alias(c)), c, "left_anti") for n, (df, c) in tables.items()}


def enrichment_rows(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """SNK12: new(document_id, text) appended behind the last chunk of each document."""
    last = chunks.groupBy("document_id").agg(F.max("ord").alias("last"))
    w = Window.partitionBy("document_id").orderBy("text")
    return new.join(last, "document_id", "left").select("document_id", (F.coalesce("last", F.lit(-1)) + F.row_number().over(w)).alias("ord"), F.lit("enrichment").alias("kind"), "text")


def stratified_allocation(items: DataFrame, folder: str, n: int) -> DataFrame:
    """TK13: how many of n items each folder gives: one at least, the rest in proportion to size - 1 by largest remainder, never above its size; with
    fewer items than folders one from each of the first n. Folders are few; sizes are one row for each."""
    f = items.groupBy(folder).agg(F.count("*").alias("size"))
    every = Window.partitionBy(F.lit(0))
    f = f.withColumn("folders", F.count("*").over(every)).withColumn("spare", F.sum(F.col("size") - 1).over(every)).withColumn("at", F.row_number().over(every.orderBy(folder)))
    left = F.greatest(F.least(F.lit(n), F.col("spare") + F.col("folders")) - F.col("folders"), F.lit(0))
    quota = F.when(F.col("spare") > 0, left * (F.col("size") - 1) / F.col("spare")).otherwise(0.0)
    f = f.withColumn("quota", quota).withColumn("base", F.floor(quota)).withColumn("left", left)
    f = f.withColumn("missing", F.col("left") - F.sum("base").over(every)).withColumn("turn", F.row_number().over(every.orderBy(F.desc(F.round(F.col("quota") - F.col("base"), 9)), folder)))
    take = F.when(F.lit(n) < F.col("folders"), F.when(F.col("at") <= n, 1).otherwise(0)).otherwise(1 + F.col("base") + F.when(F.col("turn") <= F.col("missing"), 1).otherwise(0))
    return f.select(folder, "size", F.least(take, F.col("size")).cast("bigint").alias("take"))


def stratified_sample(items: DataFrame, folder: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """TK13: the allocated number from each folder, by hash order."""
    a = stratified_allocation(items, folder, n)
    w = Window.partitionBy(folder).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return items.withColumn("rn", F.row_number().over(w)).join(a.select(folder, "take"), folder).where("rn <= take").select(key, folder)


def heading_levels(weights: DataFrame) -> DataFrame:
    """SRC13, SRC14, WN15: weights(size, chars): the size with most characters is the body; sizes above 1.12 of it are headings, the largest first, at most six levels."""
    g = weights.groupBy("size").agg(F.sum("chars").alias("chars"))
    body = F.first("size").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("chars"), "size"))
    g = g.withColumn("body", body)
    level = F.least(F.row_number().over(Window.partitionBy(F.col("size") > 1.12 * F.col("body")).orderBy(F.desc("size"))), F.lit(6))
    return g.select("size", F.when(F.col("size") > 1.12 * F.col("body"), level).alias("level"))


def permits(users: Column, groups: Column, public: Column, user: str, own: list[str]) -> Column:
    """FLT05: public, or the user is named, or a group of theirs is."""
    return F.coalesce(public, F.lit(False)) | F.array_contains(users, user) | F.arrays_overlap(groups, F.array(*map(F.lit, own)))


def in_scope(instrument: Column, wanted: str) -> Column:
    """FLT04, FLT13: no instrument, or one that holds the wanted text in any case."""
    return instrument.isNull() | (F.trim(instrument) == "") | F.contains(F.lower(instrument), F.lit(wanted.lower()))


def conflicts(vectors: DataFrame, k: int, low: float, high: float, limit: int = 200) -> DataFrame:
    """RK17, JN19, TK10: pairs of different documents among each other's k nearest, with low <= cosine < high; either side suffices. vectors(chunk_id, doc_id, vector).
    Vectors are put into blocks; each two blocks meet in one task, which answers for both sides. Null vectors and those of zeros take no part."""
    import numpy as np
    import pandas as pd

    ship(vectors.sparkSession)
    vectors = vectors.where(F.exists("vector", lambda x: x != 0))
    n = vectors.count()
    blocks = max(1, -(-n // 4096))
    b = vectors.withColumn("b", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    met = b.select("chunk_id", "doc_id", "vector", "b", pair.alias("p")).select("chunk_id", "doc_id", "vector", "b", "p.i", "p.j")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        q, x = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        parts = [pd.DataFrame({"a": pd.Series([], dtype="int64"), "da": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "db": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float64")})]
        if len(q) and len(x):
            unit = lambda v: (m := np.stack(v.to_numpy()).astype(np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
            sims = np.round(unit(q["vector"]) @ unit(x["vector"]).T, 9)
            sims[q["chunk_id"].to_numpy()[:, None] == x["chunk_id"].to_numpy()[None, :]] = -2
            for one, other, s in ((q, x, sims), (x, q, sims.T))[: 1 if i == j else 2]:
                ids = other["chunk_id"].to_numpy()
                by_id = np.argsort(ids, kind="stable")
                order = by_id[np.argsort(-s[:, by_id], axis=1, kind="stable")[:, :k]]
                rows, cols = np.repeat(np.arange(len(one)), order.shape[1]), order.ravel()
                parts.append(pd.DataFrame({"a": one["chunk_id"].to_numpy()[rows], "da": one["doc_id"].to_numpy()[rows], "b": ids[cols], "db": other["doc_id"].to_numpy()[cols], "sim": s[rows, cols]}))
        out = pd.concat(parts)
        return out[out["sim"] > -2]

    near = met.groupBy("i", "j").applyInPandas(best, "a bigint, da bigint, b bigint, db bigint, sim double")
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    near = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    near = near.where((F.col("da") != F.col("db")) & (F.col("sim") >= low) & (F.col("sim") < high))
    pairs = near.select(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b"), F.round("sim", 4).alias("similarity")).dropDuplicates(["chunk_a", "chunk_b"])
    return pairs.orderBy(F.desc("similarity"), "chunk_a", "chunk_b").limit(limit)  # a top-k report


def annotate_tiers(pairs: DataFrame, tiers: DataFrame, order: list[str]) -> DataFrame:
    """RK19: tier of either side and the authoritative one. tiers(chunk_id, tier); ``order`` from highest to lowest."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)), F.lit(len(order) + 1))
    a = tiers.select(F.col("chunk_id").alias("chunk_a"), F.col("tier").alias("tier_a"))
    b = tiers.select(F.col("chunk_id").alias("chunk_b"), F.col("tier").alias("tier_b"))
    p = pairs.join(a, "chunk_a", "left").join(b, "chunk_b", "left")
    ra, rb = rank(F.col("tier_a")), rank(F.col("tier_b"))
    return p.withColumn("authoritative", F.when(ra < rb, F.col("chunk_a")).when(rb < ra, F.col("chunk_b")))


def flags_of(dups: DataFrame, pairs: DataFrame) -> DataFrame:
    """RK18: findings as flags: one for each duplicate's hash, two for each pair."""
    one = dups.select(F.col("first_id").alias("target"), F.lit("duplicate").alias("kind"), F.col("content_hash").alias("note"))
    two = pairs.select(F.explode(F.array(F.struct(F.col("chunk_a").alias("t"), F.col("chunk_b").alias("o")), F.struct(F.col("chunk_b").alias("t"), F.col("chunk_a").alias("o")))).alias("p"))
    return one.unionByName(two.select(F.col("p.t").alias("target"), F.lit("discrepancy").alias("kind"), F.concat(F.lit("see "), F.col("p.o").cast("string")).alias("note")))


def store_type(counts: DataFrame) -> DataFrame:
    """SRC38: one row: files of code, data and doc in counts(category, n), and the type of store they call for; ties and nothing at all are documents."""
    g = counts.agg(*(F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("code", "data", "doc")))
    code, data, doc = F.col("code"), F.col("data"), F.col("doc")
    return g.withColumn("store_type", F.when((code > 0) & (code >= data) & (code > doc), "code").when((data > 0) & (data > doc), "data").otherwise("document"))
