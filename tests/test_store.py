import json

import pytest

from lodestone.store import Catalog


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, source string, content_hash string, audience string, title string")


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id long, document_id long, ord int, kind string, locator string, text string")


def test_life_of_a_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    d = docs(spark, [(1, "a.md", "s", "h1", '["ops"]', "A"), (2, "b.md", "t", "h2", "[]", "B")])
    k = chunks(spark, [(10, 1, 0, "body", "x", "relay drift"), (20, 2, 0, "body", "y", "relay gap"), (21, 2, 1, "body", "y", "chuck")])
    c.ingest(d, k)
    c.ingest(d, k)
    assert c.read("documents").count() == 2 and c.read("chunks").count() == 3
    c.ingest(docs(spark, [(3, "a.md", "s", "h9", '["ops"]', "A"), (2, "b.md", "t", "h2", "[]", "B")]), chunks(spark, [(30, 3, 0, "body", "x", "pin map"), (20, 2, 0, "body", "y", "relay gap")]))
    assert {r["doc_id"] for r in c.read("documents").collect()} == {2, 3}
    assert {r["id"] for r in c.read("chunks").collect()} == {20, 21, 30}
    q = spark.createDataFrame([(1, "relay"), (2, "pin")], "query_id int, text string")
    assert {(r["query_id"], r["chunk_id"]) for r in c.search(q).collect()} == {(1, 20), (2, 30)}
    assert {(r["query_id"], r["chunk_id"]) for r in c.search(q, roles=["ops"]).collect()} == {(2, 30)}
    c.append("relations", spark.createDataFrame([(1, 2, 3, "a.md"), (2, 3, 2, "b.md")], "id long, src_doc long, dst_doc long, dst_raw string"))
    c.append("embeddings", spark.createDataFrame([(30, "m", 1, [1.0]), (20, "m", 1, [1.0])], "chunk_id long, model string, dim int, vector array<float>"))
    c.remove_source("s")
    assert {r["doc_id"] for r in c.read("documents").collect()} == {2}
    assert [(r["id"], r["dst_doc"]) for r in c.read("relations").collect()] == [(1, None)]
    assert [r["chunk_id"] for r in c.read("embeddings").collect()] == [20]
    c.write("chunks", c.read("chunks"), files=1)
    assert c.read("chunks").count() == 2
    assert Catalog(spark, f"file://{tmp_path}/cat").read("chunks").count() == 2


def test_small_tables(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.add_feedback(spark.createDataFrame([(1, "u", "user", "5"), (2, "v", "global", "-9"), (3, "v", "user", "x"), (4, "u", "user", None)], "id long, author string, scope string, rating string"))
    assert {r["id"]: r["rating"] for r in c.read("feedback").collect()} == {1: 1, 2: -1, 3: None, 4: None}
    assert {r["id"] for r in c.visible_feedback("u").collect()} == {1, 2, 4}
    assert {r["id"] for r in c.visible_feedback("u", False).collect()} == {1, 4}
    c.add_guidance(spark.createDataFrame([("p", "", "t", "a \n b"), ("p", "X9 rev", "t", "c"), ("p", "Y", "t", "d")], "profile string, instrument string, trigger string, text string"))
    assert {r["text"] for r in c.guidance_for("p", ["t"], "x9").collect()} == {"a b", "c"}
    c.append("images", spark.createDataFrame([("s1", 1, None), ("s2", 1, "known")], "sha256 string, doc_id long, text string"))
    given = spark.createDataFrame([("s1", "new", "m"), ("s2", "other", "m"), ("s3", "x", "m")], "sha256 string, text string, model string")
    assert {r["sha256"]: r["class"] for r in c.import_enrichments(given).collect()} == {"s1": "applied", "s2": "already", "s3": "absent"}
    assert {r["sha256"]: r["class"] for r in c.import_enrichments(given).collect()} == {"s1": "already", "s2": "already", "s3": "absent"}
    assert json.loads(c.sidecar())["images"]["s1"] == {"text": "new", "model": "m"}


def test_newer_version_is_refused(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.set_meta("schema_version", "99")
    with pytest.raises(ValueError):
        Catalog(spark, f"file://{tmp_path}/cat")


def test_stored_index_is_used_until_chunks_change(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.append("documents", spark.createDataFrame([(1, "a.md", "s", "h", "[]")], "doc_id long, path string, source string, content_hash string, audience string"))
    c.append("chunks", spark.createDataFrame([(10, 1, "relay drift"), (11, 1, "needle relay"), (12, 1, "other words")], "id long, document_id long, text string"))
    q = spark.createDataFrame([(1, "needle relay")], "query_id int, text string")
    before = [tuple(r) for r in c.search(q).select("chunk_id", "score").collect()]
    c.build_index()
    assert c._index()[0].inputFiles()[0].count("/postings/") == 1
    assert [tuple(r) for r in c.search(q).select("chunk_id", "score").collect()] == before
    c.append("chunks", spark.createDataFrame([(13, 1, "needle needle relay")], "id long, document_id long, text string"))
    assert 13 in {r["chunk_id"] for r in c.search(q).collect()}
