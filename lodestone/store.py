"""A catalog on disk: a folder of Parquet tables with a schema version, and the writes and look-ups over it. Methods give DataFrames."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as T
from lodestone.operators import corpus as K
from lodestone.operators import retrieval as R
from lodestone.session import cut, ship

VERSION = 1
SCHEMAS = {
    "meta": "key string, value string",
    "documents": "doc_id bigint, path string, source string, title string, fmt string, content_hash string, status string, audience string, instrument string, text string",
    "chunks": "id bigint, document_id bigint, ord int, kind string, locator string, text string, restricts int",
    "embeddings": "chunk_id bigint, model string, dim int, vector array<float>",
    "relations": "id bigint, src_doc bigint, dst_doc bigint, dst_raw string, link_type string, confidence double",
    "flags": "doc_id bigint, chunk_id bigint, kind string, rule_id string, note string",
    "feedback": "id bigint, author string, scope string, doc_id bigint, chunk_id bigint, rating int, text string",
    "images": "sha256 string, doc_id bigint, locator string, alt string, text string, model string",
    "stdf_results": "id bigint, doc_id bigint, chunk_id bigint, test_num int, test_txt string, result double, units string, head int, site int, part_id string, insertion string, passed int, lo double, hi double, rec_type string, pin int, conditions string",
    "stdf_parts": "id bigint, doc_id bigint, part_id string, insertion string, lot string, sublot string, wafer string, x int, y int, head int, site int, hard_bin int, soft_bin int, passed int, test_time_ms int",
    "data_columns": "id bigint, doc_id bigint, dataset string, name string, kind string, units string, lo double, hi double, n int",
    "data_values": "col_id bigint, row_idx int, value double, grp string",
    "code_symbols": "key bigint, language string, kind string, name string, qualname string, signature string, docstring string, start_line int, end_line int",
    "guidance": "profile string, instrument string, trigger string, text string, origin string",
}
#: Columns that name a document, for cascades.
DOC_KEY = {"documents": "doc_id", "chunks": "document_id", "flags": "doc_id", "feedback": "doc_id", "images": "doc_id", "stdf_results": "doc_id", "stdf_parts": "doc_id", "data_columns": "doc_id", "relations": "src_doc"}


class Catalog:
    """A table is a folder of generations; a rewrite writes the next one and then points to it, so a reader, or a job that dies, never sees half of it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        ship(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        meta = {r["key"]: r["value"] for r in self.read("meta").collect()}  # a handful of rows
        if int(meta.get("schema_version", VERSION)) > VERSION:
            raise ValueError("the catalog was written by a newer version")
        if "schema_version" not in meta:
            self.set_meta("schema_version", str(VERSION))

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _generation(self, name: str) -> int:
        fs, path = self._fs()
        p = path(f"{self.folder}/{name}")
        done = [int(PurePosixPath(s.getPath().toString()).name) for s in fs.listStatus(p) if fs.exists(path(s.getPath().toString() + "/_SUCCESS"))] if fs.exists(p) else []
        return max(done, default=-1)

    def read(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(SCHEMAS[name])
        g = self._generation(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{g}") if g >= 0 else self.spark.createDataFrame([], schema)

    def _fit(self, name: str, df: DataFrame) -> DataFrame:
        schema = StructType.fromDDL(SCHEMAS[name])
        return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))

    def write(self, name: str, df: DataFrame, files: int | None = None) -> None:
        """SNK17, SNK18: replace a table at once; ``files`` compacts it. The generation before the last is removed."""
        g = self._generation(name)
        out = self._fit(name, df)
        (out.repartition(files) if files else out).write.parquet(f"{self.folder}/{name}/{g + 1}", mode="overwrite")
        if g >= 1:
            fs, path = self._fs()
            fs.delete(path(f"{self.folder}/{name}/{g - 1}"), True)

    def append(self, name: str, df: DataFrame) -> None:
        """SNK01-SNK08, SNK13: add rows."""
        g = max(0, self._generation(name))
        self._fit(name, df).write.parquet(f"{self.folder}/{name}/{g}", mode="append")

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """SNK09-SNK11, SNK15."""
        new = self._fit(name, df)
        self.write(name, K.upsert(self.read(name), new, keys, keys[0]))

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], SCHEMAS["meta"]), ["key"])

    def add_feedback(self, df: DataFrame) -> None:
        """SNK07: ratings are clamped to -1..1, what is no number has none."""
        r = F.col("rating").cast("string").try_cast("double").cast("int")
        self.append("feedback", df.withColumn("rating", F.when(r.isNotNull(), F.greatest(F.lit(-1), F.least(F.lit(1), r)))))

    def add_guidance(self, df: DataFrame) -> None:
        """SNK13."""
        self.append("guidance", df.withColumn("text", T.clean(F.col("text"))).withColumn("origin", F.lit("user")))

    def guidance_for(self, profile: str, triggers: list[str], instrument: str) -> DataFrame:
        """FLT13."""
        return self.read("guidance").where((F.col("profile") == profile) & F.col("trigger").isin(triggers) & K.in_scope(F.col("instrument"), instrument))

    def visible_feedback(self, author: str, everyone: bool = True) -> DataFrame:
        """FLT12."""
        own = F.col("author") == author
        return self.read("feedback").where(own | (F.col("scope") == "global") if everyone else own)

    def delete_documents(self, ids: DataFrame) -> None:
        """SNK14, D2: all rows of the documents go, in every table; links to them lose their target."""
        ids = ids.select("doc_id").distinct()
        gone = self.read("chunks").join(ids.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
        cols = self.read("data_columns").join(ids, "doc_id", "left_semi").select(F.col("id").alias("col_id"))
        self.write("embeddings", self.read("embeddings").join(gone, "chunk_id", "left_anti"))
        self.write("code_symbols", self.read("code_symbols").join(gone.select(F.col("chunk_id").alias("key")), "key", "left_anti"))
        self.write("data_values", self.read("data_values").join(cols, "col_id", "left_anti"))
        r = self.read("relations").join(ids.select(F.col("doc_id").alias("dst_doc"), F.lit(True).alias("__gone")), "dst_doc", "left")
        self.write("relations", r.withColumn("dst_doc", F.when(F.col("__gone").isNull(), F.col("dst_doc"))))
        for name, df in K.cascade({n: (self.read(n), c) for n, c in DOC_KEY.items()}, ids).items():
            self.write(name, df)

    def remove_source(self, source: str) -> None:
        """MS33, MS06."""
        self.delete_documents(self.read("documents").where(F.col("source") == source).select("doc_id"))

    def ingest(self, documents: DataFrame, chunks: DataFrame) -> None:
        """ST01, FLT01: documents whose (path, hash) is new replace what was there under their path, with their chunks."""
        new = K.changed(documents, self.read("documents"))
        old = self.read("documents").join(new.select("path"), "path", "left_semi").select("doc_id")
        keep, old = cut(new.select("doc_id")), cut(old)  # decided, and written, before the tables change
        new = documents.join(keep, "doc_id", "left_semi")
        if old.limit(1).count():
            self.delete_documents(old)
        self.append("documents", new)
        self.append("chunks", chunks.join(keep.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi"))

    def _stamp(self, name: str) -> str:
        """The state of a table: its generation and number of files, as every write adds some."""
        fs, path = self._fs()
        g = self._generation(name)
        return f"{g}:{len(fs.listStatus(path(f'{self.folder}/{name}/{g}')))}" if g >= 0 else "none"

    def build_index(self) -> None:
        """RK01: store the postings of all chunks, sorted by term, so that a search reads the files of its terms alone."""
        c = self.read("chunks")
        p = R.postings(c)
        p.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.folder}/postings", mode="overwrite")
        R.index_size(c).write.parquet(f"{self.folder}/index_size", mode="overwrite")
        self.set_meta("indexed", self._stamp("chunks"))

    def _index(self) -> tuple[DataFrame, DataFrame]:
        """Stored postings while they are those of the chunks, else made anew for this search."""
        stamp = [r["value"] for r in self.read("meta").where("key = 'indexed'").collect()]  # one row
        if stamp == [self._stamp("chunks")]:
            return self.spark.read.parquet(f"{self.folder}/postings"), self.spark.read.parquet(f"{self.folder}/index_size")
        c = self.read("chunks")
        return R.postings(c), R.index_size(c)

    def search(self, queries: DataFrame, k: int = 10, roles: list[str] | None = None) -> DataFrame:
        """RK02, RK08, FLT03: the best k chunks of each query, for the roles given."""
        c = self.read("chunks")
        scored = R.bm25(*self._index(), R.query_terms(queries))
        docs = self.read("documents").select("doc_id", "path", "title", "source", T.audience(F.col("audience")).alias("audience"))
        hits = scored.join(c.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("doc_id"), "locator"), "chunk_id").join(docs, "doc_id")
        return R.top(R.by_roles(hits, roles), k, (F.desc("score"), F.col("doc_id"), F.col("chunk_id")))

    def export_enrichments(self) -> DataFrame:
        """SNK24: sha256, text and model of every described picture, sorted."""
        return self.read("images").where("text IS NOT NULL").groupBy("sha256").agg(F.min("text").alias("text"), F.min("model").alias("model")).orderBy("sha256")

    def sidecar(self) -> str:
        """SNK24: as one JSON text, for hand-over of small catalogs."""
        return json.dumps({"version": 1, "images": {r["sha256"]: {"text": r["text"], "model": r["model"]} for r in self.export_enrichments().collect()}}, sort_keys=True)

    def import_enrichments(self, described: DataFrame) -> DataFrame:
        """SNK25: class of each (sha256, text, model): applied, already there, or absent here. A repeat applies nothing."""
        have = self.read("images").groupBy("sha256").agg(F.max(F.col("text").isNotNull()).alias("done"))
        r = described.join(have, "sha256", "left").withColumn("class", F.when(F.col("done").isNull(), "absent").when(F.col("done"), "already").otherwise("applied"))
        result = cut(r.select("sha256", "text", "model", "class"))  # decided before the table changes
        add = result.where("class = 'applied'").select("sha256", F.col("text").alias("__t"), F.col("model").alias("__m"))
        images = self.read("images").join(add, "sha256", "left")
        self.write("images", images.withColumn("text", F.coalesce("text", "__t")).withColumn("model", F.coalesce("model", "__m")))
        return result.select("sha256", "class")
