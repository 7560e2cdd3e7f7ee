"""Queries over documents, chunks, segments, links, flags, data columns and code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus as K
from lodestone.operators import datasets as D
from lodestone.operators import graph as G
from lodestone.session import checkpoint_dir, table
from lodestone.store import Catalog

RULES = [("do not|never|nicht", "prohibition"), ("caution|warning|achtung|attention|atenci", "hazard"), ("at least|mindestens", "minimum"), ("(a+)+$", "risky")]
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for p, n in RULES[:3]) + " END"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").dropDuplicates(["id"])


def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return K.word_chunks(table(spark, sf, "segments"))


def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """TXT01, TXT03."""
    return _chunks(spark, sf).select("id", T.snippet(F.col("text")).alias("snippet"))


def search_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """TXT04."""
    terms = T.query_terms(F.lit("relay matrix drift"))
    c = _chunks(spark, sf).where(F.arrays_overlap(T.tokens(F.col("text")), terms))
    return c.select("id", T.snippet_around(F.col("text"), terms).alias("snippet"))


def gotcha_flags(spark: SparkSession, sf: str) -> DataFrame:
    return K.rule_flags(_chunks(spark, sf).select("id", "text"), RULES)


def gotcha_tally(spark: SparkSession, sf: str) -> DataFrame:
    """SNK03."""
    return gotcha_flags(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


def query_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """TXT05 over every title."""
    return _documents(spark, sf).where("title IS NOT NULL").select("doc_id", F.array_join(T.query_terms(F.col("title")), " ").alias("terms"))


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conflict_pairs")
    tag = lambda d, c: F.concat(F.lit("[D:"), F.col(d).cast("string"), F.lit("#"), F.col(c).cast("string"), F.lit("]"))
    return p.select("chunk_a", "chunk_b", F.concat(F.lit("See "), tag("doc_a", "chunk_a"), F.lit(" and "), tag("doc_b", "chunk_a"), F.lit(" [GK] .")).alias("text"))


def citation_verify(spark: SparkSession, sf: str) -> DataFrame:
    """TXT11, TXT13, RK23: cited pairs that aren't a chunk of that document."""
    c = _cited(spark, sf).select("chunk_a", "chunk_b", F.explode(T.citations(F.col("text"))).alias("c")).where("c.kind = 'doc'")
    known = _chunks(spark, sf).select(F.col("document_id").alias("doc_id"), F.col("id").alias("chunk_id"))
    return c.select("chunk_a", "chunk_b", "c.doc_id", "c.chunk_id").join(known, ["doc_id", "chunk_id"], "left_anti").distinct()


def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """TXT12, TXT14, TXT15: number of each citation by first appearance, its address, the text without tags."""
    c = _cited(spark, sf).distinct()
    e = c.select("chunk_a", "chunk_b", T.strip_citations(F.col("text")).alias("plain"), F.posexplode(T.citations(F.col("text"))).alias("pos", "c")).where("c.kind = 'doc'")
    g = e.groupBy("chunk_a", "chunk_b", "plain", F.col("c.doc_id").alias("doc_id"), F.col("c.chunk_id").alias("chunk_id")).agg(F.min("pos").alias("pos"))
    w = K.Window.partitionBy("chunk_a", "chunk_b").orderBy("pos")
    return g.select("chunk_a", "chunk_b", "plain", F.row_number().over(w).alias("number"), T.citation_url(F.col("doc_id"), F.col("chunk_id"), "https://example.org/").alias("url"))


def name_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """TXT21 over names of data columns and tests."""
    n = table(spark, sf, "data_columns").select("name").union(table(spark, sf, "stdf_results").select(F.col("test_txt"))).distinct()
    return n.select("name", T.name_convention(F.col("name")).alias("naming"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """FN09, FN10, TXT32."""
    return _documents(spark, sf).select("doc_id", T.slug(F.coalesce("title", F.lit(""))).alias("slug"), T.sheet_cell(F.coalesce("title", F.lit(""))).alias("cell"))


def key_values(spark: SparkSession, sf: str) -> DataFrame:
    """TXT17: a text of pairs out of the conditions; the last of a key wins."""
    r = table(spark, sf, "stdf_results").where("conditions IS NOT NULL").select("conditions").distinct()
    text = F.concat(F.regexp_replace(F.regexp_replace("conditions", r'[{}"]', ""), ":", "="), F.lit(", TEMP=0, broken, =x"))
    return r.select("conditions", F.array_join(F.transform(F.array_sort(F.map_entries(T.key_values(text))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("pairs"))


def ingest_text(spark: SparkSession, sf: str) -> DataFrame:
    return K.ingest_text(_chunks(spark, sf)).select("document_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def duplicate_docs(spark: SparkSession, sf: str) -> DataFrame:
    return K.duplicate_groups(_documents(spark, sf))


def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    """FLT01: active documents are the listing; the superseded and those of one hash group are known."""
    d = _documents(spark, sf)
    known = d.where("status = 'superseded' OR source = 'bench-portal'").select("path", "content_hash")
    return K.changed(d.select("doc_id", "path", "content_hash"), known).select("doc_id", "path")


def orphaned(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    return K.orphans(d.select("doc_id", "path"), d.where("status = 'active'")).select("doc_id", "path")


def worklist_anti(spark: SparkSession, sf: str) -> DataFrame:
    """FLT18: chunks without vector."""
    v = table(spark, sf, "chunk_vectors").where("vector IS NOT NULL")
    return K.without(_chunks(spark, sf).select("id", "document_id"), v, "id", "chunk_id")


def summary_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """FLT17, JN09, JN10, AG18: documents without any chunk."""
    return K.without(_documents(spark, sf).select("doc_id", "path"), table(spark, sf, "chunks"), "doc_id", "document_id")


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK11: the row with the larger dim of each chunk; stands for the newest."""
    v = table(spark, sf, "chunk_vectors").select("chunk_id", "model", "dim")
    return K.upsert(v.where("dim < 80"), v.where("dim >= 80"), ["chunk_id"], "dim")


def cascade_counts(spark: SparkSession, sf: str) -> DataFrame:
    """SNK14: rows that stay in each table after superseded documents go."""
    gone = _documents(spark, sf).where("status = 'superseded'").select("doc_id")
    tables = {n: (table(spark, sf, n), c) for n, c in (("documents", "doc_id"), ("chunks", "document_id"), ("segments", "document_id"), ("stdf_results", "doc_id"), ("stdf_parts", "doc_id"), ("data_columns", "doc_id"))}
    out = None
    for n, df in K.cascade(tables, gone).items():
        one = df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def enrichment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SNK12."""
    new = _documents(spark, sf).where("title IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.col("title").alias("text"))
    return K.enrichment_rows(_chunks(spark, sf), new)


def source_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """AG15, AG16."""
    return _documents(spark, sf).groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("fmt", F.lit("")).alias("fmt")).agg(F.count("*").alias("n"))


def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """SNK01, SNK02, SNK08, SNK14, SNK16-SNK18, ST01, MS06, MS33: a catalog in the shared folder takes documents and chunks, takes them again (which adds nothing), loses a
    source with all that hangs on it, and is indexed. Rows by table."""
    c = Catalog(spark, f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4().hex}")
    docs = _documents(spark, sf).select("doc_id", "path", "source", "title", "fmt", F.coalesce("content_hash", F.lit("")).alias("content_hash"), "status", F.lit("[]").alias("audience"), "text")
    chunks = _chunks(spark, sf).select("id", "document_id", "ord", "kind", "locator", "text", "restricts")
    c.ingest(docs, chunks)
    c.ingest(docs, chunks)
    c.append("relations", table(spark, sf, "conflict_pairs").select(F.col("chunk_a").alias("id"), F.col("doc_a").alias("src_doc"), F.col("doc_b").alias("dst_doc"), F.lit("conflict").alias("link_type")))
    c.remove_source("bench-portal")
    c.write("chunks", c.read("chunks"), files=2)
    c.build_index()
    rows = [c.read(n).select(F.lit(n).alias("name"), F.lit(1).alias("k")) for n in ("documents", "chunks", "relations")]
    rows.append(c.read("relations").where("dst_doc IS NULL").select(F.lit("unresolved").alias("name"), F.lit(1).alias("k")))
    rows.append(spark.read.parquet(f"{c.folder}/postings").select(F.lit("words of the index").alias("name"), F.col("tf").alias("k")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("name").agg(F.sum("k").alias("rows"))


def store_audit(spark: SparkSession, sf: str) -> DataFrame:
    """AG17, AG31, AG39: counts of a catalog."""
    names = ("documents", "chunks", "segments", "chunk_vectors", "stdf_results", "stdf_parts", "data_columns", "data_values")
    out = None
    for n in names:
        one = table(spark, sf, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def ingest_audit(spark: SparkSession, sf: str) -> DataFrame:
    """AG30, FLT02, TXT24: one row of counters."""
    d = _documents(spark, sf)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return d.agg(F.count("*").alias("files"), count(empty).alias("empty"), count(~empty & (F.length("text") < 200)).alias("short"), count(F.col("title").isNull()).alias("untitled"), count(F.coalesce("content_hash", F.lit("")) == "").alias("unhashed"), count(F.size(T.audience(F.lit("[]"))) == 0).alias("no_audience"))


def stratified_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return K.stratified_allocation(_documents(spark, sf).select(F.coalesce("source", F.lit("")).alias("folder"), "doc_id"), "folder", 100)


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return K.stratified_sample(_documents(spark, sf).select(F.coalesce("source", F.lit("")).alias("folder"), "doc_id"), "folder", "doc_id", 100)


def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    """SRC13: a line's font size is stood for by its number of words below 40."""
    s = table(spark, sf, "segments").select(F.least(F.size(F.split("text", " ")), F.lit(40)).alias("size"), F.length("text").cast("bigint").alias("chars"))
    return K.heading_levels(s)


def access_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT04, FLT05, FLT09: an instrument (the first part of the path) in scope, readable by language group, of a path pattern."""
    d = _documents(spark, sf).withColumn("instrument", F.substring_index("path", "/", 1))
    ok = K.permits(F.array(F.lit("u1")), F.array(F.coalesce("lang", F.lit(""))), F.col("status") == "superseded", "u2", ["en", "de"])
    return d.where(ok & K.in_scope(F.col("instrument"), "NOTES") & F.col("path").rlike(T.glob_regex("**/*.md"))).select("doc_id", "path")


def conflict_pairs_scan(spark: SparkSession, sf: str) -> DataFrame:
    """RK17: over the embeddings in the band 0.35 to 0.999; labels stand for documents."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"), F.col("embedding").alias("vector"))
    return K.conflicts(v, 11, 0.35, 0.999)


def tier_annotated_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """RK19 over the recorded pairs; a chunk's tier follows from its document's status."""
    t = _chunks(spark, sf).join(_documents(spark, sf).select(F.col("doc_id").alias("document_id"), "status"), "document_id").select(F.col("id").alias("chunk_id"), F.when(F.col("status") == "active", "internal").otherwise("vendor").alias("tier"))
    return K.annotate_tiers(table(spark, sf, "conflict_pairs").select("chunk_a", "chunk_b").distinct(), t, ["internal", "vendor"])


def finding_flags(spark: SparkSession, sf: str) -> DataFrame:
    """RK18, JN05."""
    return K.flags_of(K.duplicate_groups(_documents(spark, sf)), table(spark, sf, "conflict_pairs").select("chunk_a", "chunk_b").distinct())


#: Apart from documents, ids of parts begin here and those of suppliers at twice that; a multiple of 50, so that ids stay divisible by 50 or not.
NODE_OFFSET = 1_000_000_000_000


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links: recorded conflicts between documents, and every line item as part to supplier."""
    c = table(spark, sf, "conflict_pairs").select(F.lit("conflict").alias("link_type"), F.col("doc_a").alias("src"), F.col("doc_b").alias("dst"), F.col("chunk_a").alias("id"))
    li = table(spark, sf, "lineitem").select(F.lit("part").alias("link_type"), (F.col("l_partkey") + NODE_OFFSET).alias("src"), (F.col("l_suppkey") + 2 * NODE_OFFSET).alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return c.unionByName(li)


def related_docs_depth2(spark: SparkSession, sf: str) -> DataFrame:
    """GR01-GR03, TK12 over all links, from every node whose id is divisible by 50."""
    e = _edges(spark, sf)
    starts = e.select(F.explode(F.array("src", "dst")).alias("start")).where("start % 50 = 0").distinct()
    return G.reach(e, starts, 2, "both")


def link_counts(spark: SparkSession, sf: str) -> DataFrame:
    """GR02, GR04 over all links."""
    return _edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min_by("link_type", F.struct("id", "link_type")).alias("link_type"))


def link_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """JN07, TXT10: each document links to its neighbour by a relative path, with a fragment."""
    d = _documents(spark, sf)
    w = K.Window.partitionBy("source").orderBy("doc_id")
    raw = F.concat(F.lit("../"), F.element_at(F.split(F.lead("path").over(w), "/"), -2), F.lit("/./"), F.substring_index(F.lead("path").over(w), "/", -1), F.lit("?v=1#top"))
    links = d.where("source IS NOT NULL").withColumn("raw", raw).where("raw IS NOT NULL").select(F.col("doc_id").alias("src_doc"), "raw")
    return G.resolve_links(links, d)


def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """SRC27, SRC28 over parts read as text."""
    return D.column_kinds(table(spark, sf, "part"))


def wide_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """SRC26."""
    return D.read_wide(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_brand")


def long_reader(spark: SparkSession, sf: str) -> DataFrame:
    """SRC25."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.pmod("event_id", F.lit(9)) == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"), F.lit("0").alias("lo"), F.lit("ms").alias("units"))
    return D.read_long(e, "event_id", "event_type", "value", lo="lo", units="units")


def column_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """AG37, AG38."""
    a = D.column_analysis(table(spark, sf, "data_columns"), table(spark, sf, "data_values"))
    sig = lambda c: F.format_string("%.6e", F.col(c))
    return a.select("col_id", "name", "n", sig("min").alias("min"), sig("max").alias("max"), F.round("cpk", 4).alias("cpk"))


def column_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.column_analysis(table(spark, sf, "data_columns"), table(spark, sf, "data_values"), True).select("col_id", "grp", "n")


_C = "c AS (SELECT DISTINCT ON (id) * FROM chunks)"
_CLEAN = r"trim(regexp_replace(COL, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]+', ' ', 'g'))"
_CITED = "t AS (SELECT DISTINCT chunk_a, chunk_b, doc_a, doc_b FROM conflict_pairs)"
_EDGES = "e AS (SELECT 'conflict' AS link_type, doc_a AS src, doc_b AS dst, chunk_a AS id FROM conflict_pairs UNION ALL SELECT 'part', l_partkey + 1000000000000, l_suppkey + 2000000000000, l_orderkey * 10 + l_linenumber FROM lineitem)"

QUERIES = {f.__name__: f for f in (word_chunks, snippets, search_snippets, gotcha_flags, gotcha_tally, query_sanitize, citation_verify, citation_numbers, name_conventions, slugs, key_values, ingest_text, duplicate_docs, incremental_skip, orphaned, worklist_anti, summary_worklist, vector_upsert, cascade_counts, enrichment_rows, source_histogram, store_audit, store_round_trip, ingest_audit, stratified_allocation, stratified_sample, heading_levels, access_filter, conflict_pairs_scan, tier_annotated_conflicts, finding_flags, related_docs_depth2, link_counts, link_resolution, column_kinds, wide_unpivot, long_reader, column_analysis, column_groups)}
SQL = {
    "word_chunks": f"""WITH s AS (SELECT *, CASE WHEN kind = 'code' OR coalesce(lag(kind) OVER w, 'code') = 'code' OR heading_path IS DISTINCT FROM lag(heading_path) OVER w THEN 1 ELSE 0 END AS st, list_filter(string_split({_CLEAN.replace('COL', "coalesce(text, '')")}, ' '), lambda x: x <> '') AS ws FROM segments WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
      g AS (SELECT *, sum(st) OVER (PARTITION BY document_id ORDER BY ord) AS g FROM s), h AS (SELECT document_id, g, CASE WHEN kind = 'code' THEN 'code' ELSE 'body' END AS kind, heading_path AS locator, flatten(list(ws ORDER BY ord)) AS words, min(ord) AS f, max(text) AS code FROM g GROUP BY document_id, g, 3, 4),
      k AS (SELECT *, len(words) AS n, CASE WHEN len(words) >= 350 THEN (len(words) - 350) // 310 + 1 ELSE 0 END AS k FROM h), m AS (SELECT *, CASE WHEN kind = 'code' THEN CASE WHEN n > 0 THEN 1 ELSE 0 END ELSE k + CASE WHEN (k = 0 AND n > 0) OR (k > 0 AND n > (k - 1) * 310 + 350) THEN 1 ELSE 0 END END AS cnt FROM k),
      i AS (SELECT *, unnest(range(cnt)) AS i FROM m) SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY f, i) - 1 AS INT) AS ord, kind, locator, CASE WHEN kind = 'code' THEN code ELSE array_to_string(words[i * 310 + 1 : i * 310 + 350], ' ') END AS text FROM i""",
    "snippets": f"WITH {_C} SELECT id, CASE WHEN length({_CLEAN.replace('COL', 'text')}) > 180 THEN {_CLEAN.replace('COL', 'text')}[1:180] || ' …' ELSE {_CLEAN.replace('COL', 'text')} END AS snippet FROM c",
    "gotcha_flags": f"WITH {_C} SELECT id, {RULES_SQL} AS label, CASE WHEN starts_with(text, '[GOTCHA] ') THEN text ELSE '[GOTCHA] ' || text END AS text FROM c WHERE {RULES_SQL} IS NOT NULL",
    "gotcha_tally": f"WITH {_C} SELECT {RULES_SQL} AS label, count(*) AS n FROM c WHERE {RULES_SQL} IS NOT NULL GROUP BY 1",
    "query_sanitize": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(title), '[\p{L}\p{N}]+'), 1) AS i FROM documents WHERE title IS NOT NULL), u AS (SELECT doc_id, w, min(i) AS i FROM t GROUP BY doc_id, w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 64) SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM (SELECT doc_id FROM documents WHERE title IS NOT NULL) LEFT JOIN u USING (doc_id) GROUP BY doc_id",
    "citation_verify": f"WITH {_CITED}, p AS (SELECT chunk_a, chunk_b, doc_a AS doc_id, chunk_a AS chunk_id FROM t UNION SELECT chunk_a, chunk_b, doc_b, chunk_a FROM t) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE document_id = p.doc_id AND id = p.chunk_id)",
    "citation_numbers": f"WITH {_CITED}, p AS (SELECT chunk_a, chunk_b, 0 AS pos, doc_a AS d FROM t UNION ALL SELECT chunk_a, chunk_b, 1, doc_b FROM t), u AS (SELECT chunk_a, chunk_b, d, min(pos) AS pos FROM p GROUP BY ALL) SELECT chunk_a, chunk_b, 'See and.' AS plain, CAST(row_number() OVER (PARTITION BY chunk_a, chunk_b ORDER BY pos) AS INT) AS number, 'https://example.org/documents/' || d || '#chunk-' || chunk_a AS url FROM u",
    "name_conventions": r"""WITH n AS (SELECT name FROM data_columns UNION SELECT test_txt FROM stdf_results), m AS (SELECT name, regexp_replace(name, '^_+|_+$', '', 'g') AS n FROM n)
      SELECT name, CASE WHEN regexp_matches(n, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') OR regexp_matches(n, '^[A-Z][A-Z0-9]+$') THEN 'SCREAMING_SNAKE' WHEN regexp_matches(n, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN 'snake_case' WHEN contains(n, '_') THEN 'mixed' WHEN regexp_matches(n, '^[A-Z][A-Za-z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(n, '^[a-z][A-Za-z0-9]*$') THEN 'camelCase' ELSE 'other' END AS naming FROM m""",
    "slugs": r"""WITH t AS (SELECT doc_id, coalesce(title, '') AS t FROM documents), s AS (SELECT *, regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS x FROM t)
      SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s[1:60] END AS slug, CASE WHEN regexp_matches(x, '^[=+\-@\t\r]') THEN '''' || x ELSE x END AS cell FROM s""",
    "ingest_text": f"WITH {_C}, t AS (SELECT document_id, string_agg(coalesce(text, ''), chr(10) ORDER BY ord, id) AS text FROM c WHERE kind NOT IN ('enrichment', 'image_ref') GROUP BY document_id) SELECT document_id, length(text) AS n_chars, md5(text) AS digest FROM t",
    "duplicate_docs": "SELECT content_hash, count(*) AS members, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT source) AS sources FROM documents WHERE status = 'active' AND coalesce(content_hash, '') <> '' GROUP BY content_hash HAVING count(*) >= 2",
    "incremental_skip": "SELECT doc_id, path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE (k.status = 'superseded' OR k.source = 'bench-portal') AND k.path = d.path AND k.content_hash = d.content_hash)",
    "orphaned": "SELECT doc_id, path FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.status = 'active' AND k.path = d.path)",
    "worklist_anti": f"WITH {_C} SELECT id, document_id FROM c WHERE id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL)",
    "summary_worklist": "SELECT doc_id, path FROM documents WHERE doc_id NOT IN (SELECT document_id FROM chunks WHERE document_id IS NOT NULL)",
    "vector_upsert": "SELECT chunk_id, model, dim FROM chunk_vectors QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY dim DESC) = 1",
    "cascade_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n} WHERE {c} NOT IN (SELECT doc_id FROM documents WHERE status = 'superseded')" for n, c in (("documents", "doc_id"), ("chunks", "document_id"), ("segments", "document_id"), ("stdf_results", "doc_id"), ("stdf_parts", "doc_id"), ("data_columns", "doc_id"))),
    "enrichment_rows": "WITH l AS (SELECT document_id, max(ord) AS last FROM chunks GROUP BY document_id) SELECT doc_id AS document_id, CAST(coalesce(last, -1) + 1 AS INT) AS ord, 'enrichment' AS kind, title AS text FROM documents LEFT JOIN l ON l.document_id = doc_id WHERE title IS NOT NULL",
    "source_histogram": "SELECT coalesce(source, '') AS source, coalesce(fmt, '') AS fmt, count(*) AS n FROM documents GROUP BY 1, 2",
    "store_round_trip": r"""WITH d AS (SELECT * FROM documents WHERE source IS DISTINCT FROM 'bench-portal'), c AS (SELECT DISTINCT ON (id) * FROM chunks WHERE document_id IN (SELECT doc_id FROM d)), r AS (SELECT * FROM conflict_pairs WHERE doc_a IN (SELECT doc_id FROM d))
      SELECT 'documents' AS name, count(*) AS rows FROM d UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'relations', count(*) FROM r UNION ALL SELECT 'unresolved', count(*) FROM r WHERE doc_b NOT IN (SELECT doc_id FROM d) HAVING count(*) > 0
      UNION ALL SELECT 'words of the index', sum(len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))) FROM c""",
    "store_audit": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "chunks", "segments", "chunk_vectors", "stdf_results", "stdf_parts", "data_columns", "data_values")),
    "ingest_audit": "WITH d AS (SELECT *, trim(coalesce(text, ''), ' ') = '' AS e FROM documents) SELECT count(*) AS files, count(*) FILTER (e) AS empty, count(*) FILTER (NOT e AND length(text) < 200) AS short, count(*) FILTER (title IS NULL) AS untitled, count(*) FILTER (coalesce(content_hash, '') = '') AS unhashed, count(*) AS no_audience FROM d",
    "stratified_allocation": """WITH f AS (SELECT coalesce(source, '') AS folder, count(*) AS size FROM documents GROUP BY 1), a AS (SELECT *, count(*) OVER () AS k, sum(size - 1) OVER () AS spare FROM f), b AS (SELECT *, greatest(least(100, spare + k) - k, 0) AS lft, greatest(least(100, spare + k) - k, 0) * (size - 1) / spare AS q FROM a),
      c AS (SELECT *, floor(q) AS base, lft - sum(floor(q)) OVER () AS missing, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, folder) AS turn FROM b) SELECT folder, size, CAST(least(1 + base + CASE WHEN turn <= missing THEN 1 ELSE 0 END, size) AS BIGINT) AS take FROM c""",
    "heading_levels": """WITH s AS (SELECT CAST(least(len(string_split(text, ' ')), 40) AS INT) AS size, length(text) AS chars FROM segments), g AS (SELECT size, sum(chars) AS chars FROM s GROUP BY size), b AS (SELECT size AS body FROM g ORDER BY chars DESC, size LIMIT 1)
      SELECT size, CASE WHEN size > 1.12 * body THEN CAST(least(row_number() OVER (PARTITION BY size > 1.12 * body ORDER BY size DESC), 6) AS INT) END AS level FROM g, b""",
    "access_filter": "SELECT doc_id, path FROM documents WHERE (status = 'superseded' OR coalesce(lang, '') IN ('en', 'de')) AND contains(lower(split_part(path, '/', 1)), 'notes') AND regexp_matches(path, '^(?:[^/]+/)*[^/]*\\.md$')",
    "tier_annotated_conflicts": f"""WITH {_C}, t AS (SELECT c.id, CASE WHEN status = 'active' THEN 'internal' ELSE 'vendor' END AS tier FROM c JOIN documents ON doc_id = document_id), p AS (SELECT DISTINCT chunk_a, chunk_b FROM conflict_pairs)
      SELECT chunk_a, chunk_b, a.tier AS tier_a, b.tier AS tier_b, CASE WHEN coalesce(a.tier, 'z') < coalesce(b.tier, 'z') THEN chunk_a WHEN coalesce(b.tier, 'z') < coalesce(a.tier, 'z') THEN chunk_b END AS authoritative FROM p LEFT JOIN t a ON a.id = chunk_a LEFT JOIN t b ON b.id = chunk_b""",
    "finding_flags": "WITH d AS (SELECT content_hash, min(doc_id) AS f FROM documents WHERE status = 'active' AND coalesce(content_hash, '') <> '' GROUP BY content_hash HAVING count(*) >= 2), p AS (SELECT DISTINCT chunk_a, chunk_b FROM conflict_pairs) SELECT f AS target, 'duplicate' AS kind, content_hash AS note FROM d UNION ALL SELECT chunk_a, 'discrepancy', 'see ' || chunk_b FROM p UNION ALL SELECT chunk_b, 'discrepancy', 'see ' || chunk_a FROM p",
    "conflict_pairs_scan": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_dot_product(a.e, b.e) / (a.n * b.n), 9) AS sim FROM v a, v b WHERE a.vec_id <> b.vec_id),
      k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 11) SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b, round(sim, 4) AS similarity FROM k WHERE la <> lb AND sim >= 0.35 AND sim < 0.999 ORDER BY similarity DESC, chunk_a, chunk_b LIMIT 200""",
    "related_docs_depth2": f"""WITH {_EDGES}, st AS (SELECT DISTINCT start FROM (SELECT src AS start FROM e UNION ALL SELECT dst FROM e) WHERE start % 50 = 0), u AS (SELECT 'out' AS dir, src AS a, dst AS b, id, link_type FROM e UNION ALL SELECT 'in', dst, src, id, link_type FROM e),
      h1 AS (SELECT dir, start, b AS doc, 1 AS hops FROM st JOIN u ON a = start WHERE b <> start GROUP BY ALL), h2 AS (SELECT h1.dir, start, b AS doc, 2 AS hops FROM h1 JOIN u ON a = doc AND u.dir = h1.dir WHERE b <> start GROUP BY ALL),
      r AS (SELECT dir, start, doc, min(hops) AS hops FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL), d AS (SELECT dir, a, b, count(*) AS weight, min_by(link_type, id) AS lt FROM u GROUP BY ALL),
      x AS (SELECT r.*, CASE WHEN hops = 1 THEN coalesce(weight, 0) ELSE 0 END AS w, CASE WHEN hops = 1 THEN coalesce(lt, '') ELSE '' END AS lt FROM r LEFT JOIN d ON d.dir = r.dir AND d.a = r.start AND d.b = r.doc)
      SELECT CAST(start AS BIGINT) AS start, doc, min(hops) AS hops, CASE WHEN count(*) > 1 THEN 'both' ELSE max(dir) END AS direction, CASE WHEN count(*) > 1 THEN 0 ELSE CAST(sum(w) AS BIGINT) END AS weight, CASE WHEN count(*) > 1 THEN '' ELSE max(lt) END AS link_type FROM x GROUP BY start, doc""",
    "link_counts": f"WITH {_EDGES} SELECT src, dst, count(*) AS weight, min_by(link_type, (id, link_type)) AS link_type FROM e GROUP BY src, dst",
    "link_resolution": """WITH l AS (SELECT doc_id AS src_doc, path, lead(path) OVER (PARTITION BY source ORDER BY doc_id) AS nx FROM documents WHERE source IS NOT NULL), m AS (SELECT *, string_split(nx, '/') AS p FROM l WHERE nx IS NOT NULL),
      r AS (SELECT src_doc, '../' || p[-2] || '/./' || p[-1] || '?v=1#top' AS raw, split_part(path, '/', 1) || '/' || p[-2] || '/' || p[-1] AS target FROM m) SELECT src_doc, raw, target, doc_id AS dst_doc FROM r LEFT JOIN documents ON documents.path = target""",
    "wide_unpivot": "WITH u AS (SELECT p_partkey AS src_row, p_brand AS grp, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice FROM part) SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY src_row) - 1 AS INT) AS row_idx, src_row, value, grp FROM u WHERE value IS NOT NULL AND isfinite(value)",
    "long_reader": "SELECT event_type AS name, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS INT) AS row_idx, value, 0.0::DOUBLE AS lo, NULL::DOUBLE AS hi, 'ms' AS units FROM events WHERE event_id % 9 <> 0",
    "column_analysis": """WITH v AS (SELECT DISTINCT ON (col_id, row_idx) * FROM data_values), g AS (SELECT col_id, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS mn, max(value) AS mx FROM v WHERE isfinite(value) GROUP BY col_id), c AS (SELECT DISTINCT ON (id) id, name, CASE WHEN isnan(lo) THEN NULL ELSE lo END AS lo, CASE WHEN isnan(hi) THEN NULL ELSE hi END AS hi FROM data_columns)
      SELECT col_id, name, n, printf('%.6e', mn) AS min, printf('%.6e', mx) AS max, round(CASE WHEN sd > 0 AND n >= 2 THEN least((mu - lo) / (3 * sd), (hi - mu) / (3 * sd)) END, 4) AS cpk FROM g JOIN c ON c.id = col_id""",
    "column_groups": "WITH v AS (SELECT DISTINCT ON (col_id, row_idx) * FROM data_values) SELECT col_id, grp, count(*) AS n FROM v WHERE isfinite(value) AND col_id IN (SELECT id FROM data_columns) GROUP BY col_id, grp",
}
