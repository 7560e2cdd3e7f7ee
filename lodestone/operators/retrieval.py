"""Index, ranking, fusion, federation and re-ranking. All queries of a batch are ranked in one job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.functions import text as T
from lodestone.session import ship

K1, B_, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
#: Words of a batch of queries that may be broadcast; beyond, the join shuffles.
BROADCAST_TERMS = 200_000
#: Vectors asked, and vectors searched, that meet as two matrices in one task.
BLOCK, SLAB = 1024, 4096
#: Chunks, and queries of words, that meet in one task; share of a block's chunks above which a word is common there. They steer speed only.
CHUNKS, QUERIES, COMMON = 65_536, 100_000, 1 / 64
TIER_BOOST, FEEDBACK_BOOST = {"internal": 0.02, "vendor": 0.0}, 0.03


def postings(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """RK01: key, term, tf, dl. Texts without tokens have no postings."""
    t = chunks.select(F.col(key).alias("chunk_id"), T.tokens(F.coalesce(text, F.lit(""))).alias("t"))
    t = t.select("chunk_id", F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def index_size(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, avgdl over all texts (empty ones count)."""
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.tokens(F.coalesce(text, F.lit(""))))).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term of queries(query_id, text)."""
    return queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term"))


def bm25(post: DataFrame, size: DataFrame, terms: DataFrame, prefix: bool = False) -> DataFrame:
    """RK02/RK04: query_id, chunk_id, score (6 dp). With ``prefix`` a term matches every word it starts and counts as one word.

    ``size`` is one row, read here. Postings without a query term are dropped by the join before anything is shuffled where
    Spark finds the terms small enough to broadcast."""
    n_docs, avgdl = size.first()
    few = terms.count() <= BROADCAST_TERMS
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if few else asked
    if prefix:
        lengths = [r[0] for r in asked.select(F.length("term")).distinct().collect()]  # at most one for each length of a word
        p = post.withColumn("cut", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).where(F.col("cut") <= F.length("term"))
        p = p.withColumn("term", F.expr("substring(term, 1, cut)")).join(asked, "term", "left_semi")
        hits = p.groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    else:
        # words that nobody asks for don't move
        hits = post.join(asked, "term", "left_semi")
    df_ = hits.groupBy("term").agg(F.count("*").alias("n"))
    raw = F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    norm = F.col("tf") + K1 * (1 - B_ + B_ * F.col("dl") / F.lit(avgdl or 1.0))
    weights = hits.join(df_, "term").select("term", "chunk_id", (idf * F.col("tf") * (K1 + 1) / norm).alias("w"))  # once for a word, however many queries have it
    if few:
        # laid out by chunk, the weights meet all queries where they are, and the sums, of which there are many more, need no shuffle
        spark = post.sparkSession
        weights, terms = weights.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id"), F.broadcast(terms)
    return weights.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))


def _packed(p: DataFrame) -> DataFrame:
    """chunk_id, dl, words (term, tf): the postings of a chunk in one row."""
    return p.groupBy("chunk_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("words"))  # no more than the words of one text


def _best_of_block(asked: pa.Table, packed: pa.Table, avgdl: float, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """query_id, chunk_id, score of the ``k`` best chunks of a block for each query, by rounded score and then by chunk_id.

    The sums over the words that are common in the block are shared by all queries with the same common words. As weights are positive, a chunk without any rare
    word of a query is among the k best of the query only if it is among the k best of the common words; all others that may be have a rare word."""
    packed = packed.sort_by("chunk_id").combine_chunks()
    asked = asked.combine_chunks()
    n_chunks, n_queries = len(packed), len(asked)
    lists, words = packed["words"].combine_chunks(), asked["words"].combine_chunks()
    flat, q_flat = lists.flatten(), words.flatten()
    vocabulary = q_flat.field("term").dictionary_encode()
    q_code, q_of = vocabulary.indices.to_numpy(), np.repeat(np.arange(n_queries), words.value_lengths().to_numpy())
    idf = np.zeros(len(vocabulary.dictionary))
    idf[q_code] = q_flat.field("idf").to_numpy()
    code = pc.fill_null(pc.index_in(flat.field("term"), value_set=vocabulary.dictionary), -1).to_numpy()
    at, tf = np.repeat(np.arange(n_chunks), lists.value_lengths().to_numpy()), flat.field("tf").to_numpy().astype(float)
    w = np.where(code >= 0, idf[code], 0.0) * tf * (K1 + 1) / (tf + K1 * (1 - B_ + B_ * packed["dl"].to_numpy()[at] / avgdl))
    order = np.argsort(code, kind="stable")
    order = order[np.searchsorted(code[order], 0) :]
    at, w, code = at[order], w[order], code[order]
    begin = np.searchsorted(code, np.arange(len(idf) + 1))
    common = np.diff(begin) > n_chunks * COMMON
    frequent: list[list[int]] = [[] for _ in range(n_queries)]
    rare: list[list[int]] = [[] for _ in range(n_queries)]
    for q, c in sorted(zip(q_of.tolist(), q_code.tolist())):
        if begin[c + 1] > begin[c]:
            (frequent if common[c] else rare)[q].append(c)
    same: dict[tuple[int, ...], list[int]] = {}
    for q, cs in enumerate(frequent):
        same.setdefault(tuple(cs), []).append(q)

    def first(pos: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        digits = np.floor(score * 1e6 + 0.5)
        if len(pos) > 4 * k:
            keep = digits >= np.partition(digits, len(pos) - k)[len(pos) - k]
            pos, digits = pos[keep], digits[keep]
        best = np.lexsort((pos, -digits))[:k]
        return pos[best], digits[best] / 1e6

    added, none = np.zeros(n_chunks), (np.zeros(0, dtype=int), np.zeros(0))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for cs, queries in same.items():
        base = np.zeros(n_chunks)
        for c in cs:
            base[at[begin[c] : begin[c + 1]]] += w[begin[c] : begin[c + 1]]
        top_base = first(there := np.flatnonzero(base), base[there]) if cs else none
        for q in queries:
            if not rare[q]:
                out.append((q, *top_base))
                continue
            runs = [slice(begin[c], begin[c + 1]) for c in rare[q]]
            for r in runs:
                added[at[r]] += w[r]
            pos = at[runs[0]] if len(runs) == 1 else np.unique(np.concatenate([at[r] for r in runs]))
            rest = top_base[0][added[top_base[0]] == 0]
            both = np.concatenate([pos, rest])
            out.append((q, *first(both, base[both] + added[both])))
            added[pos] = 0
    of = np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out])
    return asked["query_id"].combine_chunks().take(pa.array(of)), packed["chunk_id"].combine_chunks().take(pa.array(np.concatenate([x for _, x, _ in out]))), np.concatenate([x for _, _, x in out])


def bm25_best(post: DataFrame, size: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """RK08, TK01: query_id, chunk_id, score, rank of the ``k`` best chunks of each query, however many queries: as ``bm25`` and ``top`` give them, without
    a row for each query and each of its chunks. Blocks of chunks meet blocks of queries in a task, and only the best of each two blocks move.

    ``size`` is one row, read here, as are the numbers of queries and of their words."""
    spark = post.sparkSession
    ship(spark)
    n_docs, avgdl = size.first()
    n_queries, n_words = terms.agg(F.count_distinct("query_id"), F.count_distinct("term")).first()
    blocks, slabs = max(n_docs // CHUNKS + 1, min(2 * spark.sparkContext.defaultParallelism, n_docs // 1000 + 1)), n_queries // QUERIES + 1
    if n_words <= BROADCAST_TERMS:  # words that nobody asks for don't move; more words than that stay with their chunk, whose row moves once
        post = post.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    raw = F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)
    known = terms.join(post.groupBy("term").agg(F.count("*").alias("n")), "term").select("query_id", "term", idf.alias("idf"))
    asked = known.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("words"))  # at most MAX_TERMS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("query_id", "words", F.pmod(F.hash("query_id"), F.lit(slabs)).alias("slab"), every(blocks).alias("block"))
    packed = _packed(post).select("chunk_id", "dl", "words", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), every(slabs).alias("slab"))
    schema = StructType([StructField("query_id", terms.schema["query_id"].dataType), StructField("chunk_id", post.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    kinds = to_arrow_schema(schema).types

    def meet(a: pa.Table, p: pa.Table) -> pa.Table:
        got = _best_of_block(a, p, avgdl or 1.0, k) if a.num_rows and p.num_rows else [pa.array([], t) for t in kinds]
        return pa.table(dict(zip(("query_id", "chunk_id", "score"), got)))

    met = asked.groupBy("block", "slab").cogroup(packed.groupBy("block", "slab")).applyInArrow(meet, schema)
    return top(met, k, (F.desc("score"), F.asc_nulls_last("chunk_id")))


def top(scored: DataFrame, k: int, by: tuple[Column, ...], per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """TK01/TK04: rows of rank 1..k in each group; the window's limit is pushed below the shuffle."""
    w = Window.partitionBy(*per).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """JN01: document, path, title and locator of each hit."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id"), "locator", "text")
    d = documents.select("doc_id", "path", "title", "source")
    return hits.join(c, "chunk_id").join(d, "doc_id", "left")


def by_roles(hits: DataFrame, roles: list[str] | None) -> DataFrame:
    """FLT03: audience and roles overlap; no roles, no filter; with roles an empty audience drops out."""
    return hits if roles is None else hits.where(F.arrays_overlap("audience", F.array(*map(F.lit, roles))))


def pool_size(k: int, roles: list[str] | None, fusion: bool = False) -> int:
    """TK02/TK03."""
    pool = k if roles is None else max(5 * k, 50)
    return max(pool, 4 * k, 40) if fusion else pool


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """RK05/D9: query_id, chunk_id, sim (cosine, 6 dp) of queries(query_id, vector), a few of them, against every row of vectors(chunk_id, vector). Dimensions must agree (RK14/RK16)."""
    q = queries.select("query_id", F.col("vector").alias("qv"))
    both = vectors.join(F.broadcast(q), F.size("vector") == F.size("qv"))
    return both.select("query_id", "chunk_id", F.round(dot(F.col("vector"), F.col("qv")) / (norm(F.col("vector")) * norm(F.col("qv"))), 6).alias("sim"))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """RK05, TK04: query_id, chunk_id, sim, rank of the k best rows of vectors(chunk_id, vector) for each of queries(query_id, vector), however many: blocks
    of queries and slabs of rows of about BLOCK and SLAB meet in one group each, nothing is broadcast. Exact: a slab passes on all rows that rounding might
    put among its k best. Only equal dimensions meet; the cosine with a vector of zeros is 0."""
    ship(vectors.sparkSession)
    blocks, slabs = -(-queries.count() // BLOCK) or 1, -(-vectors.count() // SLAB) or 1
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), part("chunk_id", slabs).alias("slab")).select("*", every(blocks).alias("block"))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), part("query_id", blocks).alias("block")).select("*", every(slabs).alias("slab"))

    def unit(c: pd.Series) -> np.ndarray:
        m = np.stack(c.to_numpy())
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "sim": []})
        sim = unit(asked["vector"]) @ unit(rows["vector"]).T
        kth = np.partition(sim, -k, axis=1)[:, -k] if k < sim.shape[1] else np.full(len(sim), -2.0)
        i, j = np.nonzero(sim >= kth[:, None] - 2e-6)  # six decimals are kept
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[i], "chunk_id": rows["chunk_id"].to_numpy()[j], "sim": sim[i, j]})

    types = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, sim double"
    by = ("dim", "block", "slab")
    near = v.where("dim > 0").groupBy(*by).cogroup(q.where("dim > 0").groupBy(*by)).applyInPandas(run, types).withColumn("sim", F.round("sim", 6))
    return top(near, k, (F.desc("sim"), F.col("chunk_id")))


def rrf(ranked: list[DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """RK07: query_id, key, score: sum of 1 / (k + rank) over the lists."""
    every = reduce(DataFrame.unionByName, [r.select("query_id", key, "rank") for r in ranked])
    return every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def federated(pools: list[DataFrame], k: int) -> DataFrame:
    """RK09: one RRF over the signals of all stores. Each pool: query_id, store, chunk_id, content_hash, ord, signal, score. The best score
    of a content (hash, ord) stands for it; a blank hash never merges."""
    every = reduce(DataFrame.unionByName, pools)
    key = F.when(F.coalesce("content_hash", F.lit("")) != "", F.concat_ws("#", "content_hash", F.col("ord").cast("string"))).otherwise(F.concat_ws("/", "store", F.col("chunk_id").cast("string")))
    best = every.withColumn("key", key).groupBy("query_id", "signal", "key").agg(F.max("score").alias("score"))
    ranked = top(best, 1 << 30, (F.desc("score"), F.col("key")), ("query_id", "signal"))
    fused = ranked.groupBy("query_id", "key").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(fused, k, (F.desc("score"), F.col("key")))


def rerank(hits: DataFrame, feedback: DataFrame, tiers: DataFrame) -> DataFrame:
    """RK12/RK13: score plus tier boost plus net feedback; ties keep their rank. feedback(doc_id, net), tiers(source, tier)."""
    boost = reduce(lambda c, t: c.when(F.col("tier") == t, F.lit(TIER_BOOST[t])), TIER_BOOST, F.when(F.lit(False), 0.0)).otherwise(0.0)
    x = hits.join(feedback, "doc_id", "left").join(tiers, "source", "left")
    x = x.withColumn("new_score", F.round(F.col("score") + boost + FEEDBACK_BOOST * F.coalesce("net", F.lit(0)), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    return x.withColumn("new_rank", F.row_number().over(w).cast("bigint"))


def graded(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """AG35: query_id, passed: any expected substring in any hit's path. golden(query_id, expect array)."""
    h = hits.groupBy("query_id").agg(F.collect_list("path").alias("paths"))  # k paths
    ok = F.exists("expect", lambda e: F.exists(F.coalesce("paths", F.array().cast("array<string>")), lambda p: F.contains(p, e)))
    return golden.join(h, "query_id", "left").select("query_id", ok.alias("passed"))
