import pytest
from pyspark.sql import functions as F

from lodestone.operators import entries as E


def test_images(spark):
    rows = [(1, "a", bytearray(b"x"), "alt", None, "s.png"), (2, "b", bytearray(b"x"), "", "cap", "t.png"), (3, "c", None, None, None, "gone.png")]
    i = spark.createDataFrame(rows, "doc_id long, locator string, content binary, alt string, caption string, src string")
    unique, refs = E.stage_images(i)
    assert [(r["doc_id"], r["uses"]) for r in unique.collect()] == [(1, 2)]
    assert {r["text"] for r in refs.collect()} == {"alt s.png", "cap t.png", "gone.png"}
    hits = spark.createDataFrame([(1, "a"), (9, "z")], "doc_id long, locator string")
    assert {r["doc_id"]: len(r["images"]) for r in E.with_images(hits, refs.where("sha256 IS NOT NULL")).collect()} == {1: 1, 9: 0}
    new = spark.createDataFrame([("k1", None), ("k2", "own")], "k string, text string")
    old = spark.createDataFrame([("k1", "before"), ("k2", "other")], "k string, text string")
    assert {r["k"]: r["text"] for r in E.restore(new, old, "k", ["text"]).collect()} == {"k1": "before", "k2": "own"}


def test_patterns_and_filters(spark):
    import re

    assert re.search(E.fnmatch("A*[0-9]?.txt"), "abc5x.TXT") and not re.search(E.fnmatch("a[!b]"), "ab")
    s = spark.createDataFrame([("c", "f_One", "A.f_One"), ("c", "g", "A.one")], "language string, name string, qualname string")
    assert E.like_name(s, "%ONE", language="c").count() == 2
    r = spark.createDataFrame([(1, "Ptr"), (2, "MIR")], "doc_id long, rec_type string")
    assert E.raw_records(r, 1, "ptr").count() == 1 and E.raw_records(r).count() == 2
    d = spark.createDataFrame([("a",), ("b",)], "store string")
    assert E.chosen_stores(d, ["a"], ["a", "b"]).count() == 1 and E.chosen_stores(d, None, []).count() == 2
    with pytest.raises(ValueError):
        E.chosen_stores(d, ["x"], ["a", "b"])
    assert E.batch_top_k(10, 5) == 5 and E.batch_top_k(10, 4) == 10


def test_conversions(spark):
    df = spark.createDataFrame([("7",), (" -2.9 ",), ("x",), (None,), ("1e30",)], "s string")
    assert [r[0] for r in df.select(E.as_int(F.col("s"))).collect()] == [7, -2, None, None, None]
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(E.vector_of(E.vector_bytes(F.col("v")))).collect()] == [[1.5, -2.0], None]
    j = spark.createDataFrame([('ok {"a": {"b": 1}} end',), ("{bad",), ("none",)], "s string")
    assert [r[0] for r in j.select(E.reply_json(F.col("s"))).collect()] == ['{"a": {"b": 1}}', None, None]
    assert E.approved_rules('{"approved": true, "gotcha_patterns": [{"pattern": "x", "label": "y"}]}') == [("x", "y")]
    assert E.approved_rules('{"approved": "true", "gotcha_patterns": []}') == [] and E.approved_rules("[") == []


def test_selectors(spark):
    page = "<body><nav>a b c</nav><main class='doc'>" + "long text " * 20 + "</main><div class='side-menu x'>ok</div></body>"
    df = spark.createDataFrame([(page,)] * 9 + [("<p>bare</p>",), (None,)], "html string")
    got = {r["selector"]: r["proposed"] for r in E.propose_selectors(df).collect()}
    assert got["main"] and got["nav"] and got[".side-menu"]


def test_streams(spark, tmp_path):
    from lodestone.streaming.ingest import maintenance, progress_to, sticky_stream

    seen = []
    q = maintenance(spark, lambda: seen.append(1), once=True)
    q.awaitTermination(60)
    assert seen
    told = []
    listener = progress_to(lambda *a: told.append(a))
    spark.streams.addListener(listener)
    rows = [(1, 0, "DTR", "COND: A=1, B=2"), (1, 1, "PTR", None), (1, 2, "DTR", "COND_OFF: A"), (1, 3, "PTR", None), (1, 4, "PRR", None), (1, 5, "FTR", None), (2, 0, "PTR", None)]
    spark.createDataFrame(rows, "run long, ord long, rec_type string, text string").coalesce(1).write.parquet(str(tmp_path / "r"))
    s = sticky_stream(spark.readStream.schema("run long, ord long, rec_type string, text string").parquet(str(tmp_path / "r")))
    q = s.writeStream.format("memory").queryName("sticky").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["run"], r["ord"]): r["cond"] for r in spark.table("sticky").collect()} == {(1, 1): "A=1,B=2", (1, 3): "B=2", (1, 5): "", (2, 0): ""}
    spark.streams.removeListener(listener)


def test_value_sample_keeps_20000_of_a_test(spark, tmp_path):
    from lodestone.plans import entries as PE

    n = F.when(F.col("id") < 20_003, F.lit(1)).otherwise(F.lit(2))
    li = spark.range(20_303).select(n.cast("bigint").alias("l_partkey"), F.col("id").cast("double").alias("l_extendedprice"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_orderkey"), F.to_date(F.lit("1998-01-01")).alias("l_shipdate"), F.lit(0.01).alias("l_discount"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["test"]: (r["n"], r["last"]) for r in PE.value_sample(spark, str(tmp_path)).groupBy("test").agg(F.count("*").alias("n"), F.max("result").alias("last")).collect()}
    assert got == {1: (20_000, 19_999.0), 2: (300, 20_302.0)}
