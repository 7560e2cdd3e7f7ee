"""Queries over the index, vectors, fusion, federation, feedback and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.session import table

ASKED = [(1, "relay matrix drift of the needle array"), (2, "Kontaktblock Prüfung Grenzwerte"), (3, "cookie session console"), (4, "limit file reading T3469"), (5, "nettoyage caméra alignement")]
ASKED_SQL = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ASKED) + ") AS q(query_id, text)"
TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").dropDuplicates(["id"])


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, text string")


def _bm25(spark: SparkSession, sf: str, prefix: bool = False, asked: DataFrame | None = None) -> DataFrame:
    c = _chunks(spark, sf)
    terms = R.query_terms(_asked(spark) if asked is None else asked)
    return R.bm25(R.postings(c), R.index_size(c), terms, prefix)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """RK02, TK01, JN01: ten best chunks of each query with their document."""
    best = R.top(_bm25(spark, sf), 10, (F.desc("score"), F.col("chunk_id")))
    return R.hydrate(best, _chunks(spark, sf), table(spark, sf, "documents")).select("query_id", "rank", "chunk_id", "doc_id", "score", "path")


def bm25_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """RK04."""
    asked = spark.createDataFrame([(1, "calib tim"), (2, "prüf"), (3, "re")], "query_id int, text string")
    return R.top(_bm25(spark, sf, True, asked), 10, (F.desc("score"), F.col("chunk_id"))).select("query_id", "rank", "chunk_id", "score")


def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """RK08: every document title is a query, all in one job."""
    d = table(spark, sf, "documents").where("title IS NOT NULL").groupBy("title").agg(F.min("doc_id").cast("int").alias("query_id")).select("query_id", F.col("title").alias("text"))
    c = _chunks(spark, sf)
    return R.bm25_best(R.postings(c), R.index_size(c), R.query_terms(d), 3).select("query_id", "rank", "chunk_id", "score")


def matching_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """RK03: unranked ids with their number of matched terms."""
    return R.postings(_chunks(spark, sf)).join(R.query_terms(_asked(spark)), "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("terms"))


def role_filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    """FLT03: the audience of a document is its language here."""
    docs = table(spark, sf, "documents").select("doc_id", F.array(F.lower(F.trim(F.coalesce("lang", F.lit(""))))).alias("audience"))
    hits = _bm25(spark, sf).join(_chunks(spark, sf).select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id")), "chunk_id").join(docs, "doc_id")
    return R.top(R.by_roles(hits, ["en", "fr"]), 5, (F.desc("score"), F.col("chunk_id"))).select("query_id", "rank", "chunk_id", "score")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("doc_id"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """RK05, TK04: every row whose id is divisible by 50 asks all rows."""
    v = _vectors(spark, sf)
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return R.vector_top(v, asked, 10).select("query_id", "rank", "chunk_id", "sim")


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """RK06, RK07: words and vectors fused, all queries in one job: vector v stands for chunk v + 1, and every vector whose id is divisible by 50 asks,
    together with the words of the title of its chunk's document."""
    pool = R.pool_size(10, None, fusion=True)
    v = _vectors(spark, sf)
    asked = v.where("chunk_id % 50 = 0").select((F.col("chunk_id") + 1).alias("query_id"), "vector")
    titles = _chunks(spark, sf).select(F.col("id").alias("query_id"), F.col("document_id").alias("doc_id")).join(table(spark, sf, "documents").where("title IS NOT NULL").select("doc_id", F.col("title").alias("text")), "doc_id")
    words = R.top(_bm25(spark, sf, False, titles.join(asked.select("query_id"), "query_id", "left_semi").select("query_id", "text")), pool, (F.desc("score"), F.col("chunk_id")))
    near = R.vector_top(v.withColumn("chunk_id", F.col("chunk_id") + 1), asked, pool)
    return R.top(R.rrf([words, near]), 10, (F.desc("score"), F.col("chunk_id"))).select("query_id", "rank", "chunk_id", "score")


def federated_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """RK09, SET05: stores are the kinds of status; equal content of two stores counts once. One signal is BM25, the other the share of query terms present."""
    c = _chunks(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("status", F.lit("none")).alias("store"), "content_hash"), "document_id")
    about = c.select(F.col("id").alias("chunk_id"), "store", "content_hash", "ord")
    words = R.postings(c).join(R.query_terms(_asked(spark)), "term").groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("score"))
    scored = _bm25(spark, sf)
    best = lambda s: R.top(s.join(about, "chunk_id"), R.pool_size(10, None, fusion=True), (F.desc("score"), F.col("chunk_id")), ("query_id", "store"))
    pools = [best(s).withColumn("signal", F.lit(name)).select("query_id", "store", "chunk_id", "content_hash", "ord", "signal", "score") for name, s in (("bm25", scored), ("terms", words))]
    return R.federated(pools, 10).select("query_id", "rank", "key", "score")


def feedback_scores(spark: SparkSession, sf: str) -> DataFrame:
    """AG20, SNK07, WN14: author, document and rating come from events."""
    return _net(_ratings(spark, sf))


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    rating = F.when(F.col("event_type") == "error", -3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 0)
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("author"), k.alias("doc_id"), F.when(rating.isNotNull(), F.greatest(F.lit(-1), F.least(F.lit(1), rating))).alias("rating"))


def _net(f: DataFrame) -> DataFrame:
    last = f.where("rating IS NOT NULL").groupBy("author", "doc_id").agg(F.max_by("rating", "id").alias("rating"))
    return last.groupBy("doc_id").agg(F.sum("rating").alias("net"), F.count("*").alias("raters"))


def feedback_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """RK12, JN22: a source named "...-notes" or "...-in" is a vendor's."""
    hits = bm25_topk(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")), "doc_id")
    tiers = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source")).distinct().withColumn("tier", F.when(F.col("source").rlike("-(notes|in)$"), "vendor").otherwise("internal"))
    return R.rerank(hits, _net(_ratings(spark, sf)).select("doc_id", "net"), tiers).select("query_id", "new_rank", "chunk_id", "new_score")


def golden_grading(spark: SparkSession, sf: str) -> DataFrame:
    """AG35."""
    golden = spark.createDataFrame([(1, ["bench-portal"]), (2, ["pruefwissen"]), (3, ["no-such-path"]), (4, ["app-notes", "team-notes"]), (5, ["aide-testeur"])], "query_id int, expect array<string>")
    return R.graded(bm25_topk(spark, sf), golden)


_BM = rf"""c AS (SELECT DISTINCT ON (id) id, document_id, ord, text FROM chunks),
t AS (SELECT id, {TOK} AS w FROM c),
p AS (SELECT id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY id, term),
size AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM t)"""
_TERMS = r"qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM ASKED)"
_SCORE = """s AS (SELECT query_id, id AS chunk_id, round(sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS n FROM h) , size GROUP BY query_id, id)"""
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"


def _ranked(asked: str = ASKED_SQL, match: str = "p JOIN qt USING (term)") -> str:
    return f"WITH {_BM}, {_TERMS.replace('ASKED', asked)}, h AS (SELECT * FROM {match}), {_SCORE}, {_RANKED}"


_TOPK = _ranked() + ", k AS (SELECT query_id, rank, chunk_id, document_id AS doc_id, score, path FROM r JOIN c ON c.id = chunk_id LEFT JOIN documents d ON d.doc_id = document_id WHERE rank <= 10)"
_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
_RATE = """f AS (SELECT event_id AS id, user_id AS author, CAST(json_extract_string(props, '$.k') AS INT) AS doc_id, CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 WHEN 'view' THEN 0 END AS rating FROM events),
last AS (SELECT author, doc_id, max_by(rating, id) AS rating FROM f WHERE rating IS NOT NULL GROUP BY author, doc_id),
net AS (SELECT doc_id, CAST(sum(rating) AS BIGINT) AS net, count(*) AS raters FROM last GROUP BY doc_id)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_prefix, bm25_batch, matching_chunks, role_filtered_search, vector_topk, hybrid_rrf, federated_rrf, feedback_scores, feedback_rerank, golden_grading)}
SQL = {
    "bm25_topk": _TOPK + " SELECT * FROM k",
    "bm25_prefix": _ranked("(VALUES (1, 'calib tim'), (2, 'prüf'), (3, 're')) AS q(query_id, text)", "(SELECT query_id, qt.term, p.id, sum(tf) AS tf, max(dl) AS dl FROM p JOIN qt ON starts_with(p.term, qt.term) GROUP BY query_id, qt.term, p.id)") + " SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10",
    "bm25_batch": _ranked("(SELECT CAST(min(doc_id) AS INT) AS query_id, title AS text FROM documents WHERE title IS NOT NULL GROUP BY title)") + " SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 3",
    "matching_chunks": f"WITH {_BM}, {_TERMS.replace('ASKED', ASKED_SQL)} SELECT query_id, id AS chunk_id, count(*) AS terms FROM p JOIN qt USING (term) GROUP BY ALL",
    "role_filtered_search": f"WITH {_BM}, {_TERMS.replace('ASKED', ASKED_SQL)}, h AS (SELECT * FROM p JOIN qt USING (term)), {_SCORE.replace('s AS', 's0 AS', 1)}, s AS (SELECT s0.* FROM s0 JOIN c ON c.id = chunk_id JOIN documents d ON d.doc_id = document_id WHERE lower(trim(coalesce(lang, ''))) IN ('en', 'fr')), {_RANKED} SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 5",
    "vector_topk": f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {_COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank, chunk_id, sim FROM s) WHERE rank <= 10",
    "hybrid_rrf": _ranked("(SELECT id AS query_id, title AS text FROM c JOIN documents d ON d.doc_id = c.document_id JOIN embeddings ON vec_id + 1 = id WHERE vec_id % 50 = 0 AND title IS NOT NULL)")
    + f""", v AS (SELECT b.vec_id + 1 AS query_id, a.vec_id + 1 AS chunk_id, {_COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0),
      vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM v),
      u AS (SELECT query_id, chunk_id, rank FROM r WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, rank FROM vr WHERE rank <= 40),
      g AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)
      SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM g) WHERE rank <= 10""",
    "federated_rrf": _ranked() + """, w AS (SELECT query_id, id AS chunk_id, count(*)::DOUBLE AS score FROM h GROUP BY ALL),
      a AS (SELECT 'bm25' AS signal, * FROM s UNION ALL SELECT 'terms', * FROM w),
      b AS (SELECT signal, query_id, chunk_id, score, coalesce(status, 'none') AS store, content_hash, ord FROM a JOIN c ON c.id = chunk_id JOIN documents d ON d.doc_id = document_id QUALIFY row_number() OVER (PARTITION BY signal, query_id, store ORDER BY score DESC, chunk_id) <= 40),
      k AS (SELECT query_id, signal, CASE WHEN coalesce(content_hash, '') <> '' THEN content_hash || '#' || ord ELSE store || '/' || chunk_id END AS key, max(score) AS score FROM b GROUP BY ALL),
      kr AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, key) AS rank FROM k),
      g AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM kr GROUP BY ALL)
      SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank, key, score FROM g) WHERE rank <= 10""",
    "feedback_scores": f"WITH {_RATE} SELECT * FROM net",
    "feedback_rerank": _TOPK + f""", {_RATE}, z AS (SELECT k.query_id, k.rank, k.chunk_id, round(k.score + CASE WHEN regexp_matches(coalesce(source, ''), '-(notes|in)$') THEN 0.0 ELSE 0.02 END + 0.03 * coalesce(net, 0), 6) AS new_score
      FROM k JOIN documents d USING (doc_id) LEFT JOIN net ON net.doc_id = k.doc_id)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS new_rank, chunk_id, new_score FROM z""",
    "golden_grading": _TOPK + """, e AS (SELECT * FROM (VALUES (1, ['bench-portal']), (2, ['pruefwissen']), (3, ['no-such-path']), (4, ['app-notes', 'team-notes']), (5, ['aide-testeur'])) AS g(query_id, expect))
      SELECT query_id, coalesce(bool_or(contains(path, x)), false) AS passed FROM (SELECT query_id, unnest(expect) AS x FROM e) LEFT JOIN k USING (query_id) GROUP BY query_id""",
}
