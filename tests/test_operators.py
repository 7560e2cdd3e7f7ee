import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import conditions as C
from lodestone.operators import corpus as K
from lodestone.operators import datasets as D
from lodestone.operators import graph as G
from lodestone.operators import measure as M
from lodestone.operators import parts as P
from lodestone.operators import retrieval as R


def chunk_machine(segments, size, overlap):
    """The packing as a state machine over one document's segments."""
    v, out, buf, fresh, path, emitted = min(max(overlap, 0), max(size - 1, 0)), [], [], 0, object(), 0

    def close():
        nonlocal buf, fresh, emitted
        if buf and (fresh or not emitted):
            out.append(("body", path, " ".join(buf)))
        buf, fresh, emitted = [], 0, 0

    for kind, heading, text in segments:
        if kind == "code":
            close()
            path = object()
            if text.split():
                out.append(("code", heading, text))
            continue
        if heading != path:
            close()
            path = heading
        for w in text.split():
            buf.append(w)
            fresh += 1
            if len(buf) == size:
                out.append(("body", path, " ".join(buf)))
                emitted += 1
                buf, fresh = buf[size - v :] if v else [], 0
    close()
    return out


def test_chunker_equals_its_machine(spark):
    rng = random.Random(7)
    docs = []
    for d in range(120):
        docs.append([(rng.choice(["body", "body", "body", "code"]), rng.choice(["A", "B", None]), " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 5, 9, 10, 11, 23])))) for _ in range(rng.randrange(0, 7))])
    rows = [(d, i, k, h, t) for d, segs in enumerate(docs) for i, (k, h, t) in enumerate(segs)]
    df = spark.createDataFrame(rows, "document_id long, ord int, kind string, heading_path string, text string").repartition(5)
    for size, overlap in ((10, 3), (5, 0), (4, 9), (1, 0)):
        got = {}
        for r in K.word_chunks(df, size, overlap).orderBy("document_id", "ord").collect():
            got.setdefault(r["document_id"], []).append((r["kind"], r["locator"], r["text"]))
        for d, segs in enumerate(docs):
            assert got.get(d, []) == chunk_machine(segs, size, overlap), (size, overlap, segs)


def test_sticky_conditions_equal_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for run in range(30):
        for o in range(60):
            kind = rng.choice(["DTR", "DTR", "PTR", "PTR", "PRR", "FTR"])
            text = rng.choice(["COND: A=1, B=2", f"COND A={o}", "COND_OFF: A", "COND_OFF", "COND_OFF: *", "COND_OFFICER=1", "note", None, "COND: =x, C=", "COND_OFF: A, B", "COND_OFF A,B", " COND_OFF B ", "COND: A=7, A=8", "COND:B=a=b"]) if kind == "DTR" else None
            rows.append((run, o, kind, text))
    df = spark.createDataFrame(rows, "run int, ord int, rec_type string, text string").repartition(4)
    for scope in (True, False):
        got = {(r["run"], r["ord"]): r["cond"] for r in C.sticky_conditions(df, scope).collect()}
        state = {}
        for run, o, kind, text in rows:
            if o == 0:
                state = {}
            said = (text or "").strip() if kind == "DTR" else ""
            if said.startswith("COND_OFF") and not said[8:9].isalnum():
                body = said[8:].strip().removeprefix(":").strip()
                if body in ("", "*"):
                    state = {}
                elif " " not in body:  # one key, else no rule matches
                    state.pop(body, None)
            elif said.startswith("COND:"):
                for pair in said[5:].split(","):
                    k, eq, v = pair.partition("=")
                    if eq and k.strip():
                        state[k.strip()] = v.strip()
            elif kind == "PRR" and scope:
                state = {}
            elif kind in ("PTR", "FTR"):
                assert got[(run, o)] == state, (run, o, scope)


def test_conditions_by_rules_of_the_caller(spark):
    rows = [(1, 0, "DTR", "SET T=25"), (1, 1, "PTR", None), (1, 2, "DTR", "COND: A=1"), (1, 3, "PTR", None), (1, 4, "DTR", "UNSET T"), (1, 5, "PTR", None), (2, 0, "PTR", None)]
    df = spark.createDataFrame(rows, "run int, ord int, rec_type string, text string")
    own = ((r"^UNSET (\S+)$", "clear"), (r"^SET (.+)$", "set"))
    got = {(r["run"], r["ord"]): r["cond"] for r in C.sticky_conditions(df, rules=own).collect()}
    assert got == {(1, 1): {"T": "25"}, (1, 3): {"T": "25"}, (1, 5): {}, (2, 0): {}}
    assert C.sticky_conditions(df.limit(0)).count() == 0


def test_parts_of_several_sites(spark):
    rows = [(1, 0, "PIR", 1, 1, None), (1, 1, "PIR", 1, 2, None), (1, 2, "PTR", 1, 1, None), (1, 3, "PTR", 1, 2, None), (1, 4, "PRR", 1, 2, "p2"), (1, 5, "PRR", 1, 1, " "), (1, 6, "PTR", 1, 1, None)]
    df = spark.createDataFrame(rows, "run int, ord int, rec_type string, head int, site int, part_id string")
    got = {r["ord"]: r["part"] for r in C.assign_parts(df).collect()}
    assert (got[2], got[3], got[6]) == ("1", "p2", "")


def test_static_inheritance(spark):
    rows = [(1, 0, 5, "T", "V", 1.0, 9.0, 0), (1, 1, 5, "", "", 2.0, 8.0, 0x10), (1, 2, 5, "U", None, 2.0, 8.0, 0x40), (1, 3, 5, None, None, None, 7.0, None), (1, 4, 5, None, None, 3.0, 3.0, 0x80), (1, 5, 5, None, None, 3.0, 3.0, 0x20)]
    df = spark.createDataFrame(rows, "run int, ord int, test_num int, test_txt string, units string, lo double, hi double, opt_flag int")
    got = [(r["test_txt"], r["units"], r["lo"], r["hi"]) for r in C.inherit_static(df).orderBy("ord").collect()]
    assert got == [("T", "V", 1.0, 9.0), ("T", "V", 1.0, 8.0), ("U", "V", None, 8.0), ("T", "V", 1.0, 7.0), ("T", "V", 3.0, None), ("T", "V", 3.0, 9.0)]


def test_bm25_equals_sqlite(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["relay", "drift", "chuck", "pin", "gap", "the"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)] + ["the", ""]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for q in ("relay gap", "the", "pin pin chuck", "absent"):
        want = {i: round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{t}"' for t in dict.fromkeys(q.split())),))}
        terms = R.query_terms(spark.createDataFrame([(1, q)], "query_id int, text string"))
        got = {r["chunk_id"]: r["score"] for r in R.bm25(R.postings(df), R.index_size(df), terms).collect()}
        assert got == pytest.approx(want, abs=2e-6)


def test_federation_merges_equal_content_only(spark):
    cols = "query_id int, store string, chunk_id long, content_hash string, ord int, signal string, score double"
    a = spark.createDataFrame([(1, "a", 1, "h", 0, "bm25", 3.0), (1, "a", 2, "", 0, "bm25", 2.0)], cols)
    b = spark.createDataFrame([(1, "b", 1, "h", 0, "bm25", 5.0), (1, "b", 2, "", 0, "bm25", 2.0)], cols)
    assert [r["key"] for r in R.federated([a, b], 10).orderBy("rank").collect()] == ["h#0", "a/2", "b/2"]
    assert R.pool_size(10, None) == 10 and R.pool_size(10, ["x"]) == 50 and R.pool_size(10, None, True) == 40


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.0], [1.0, 2.0, None, float("nan"), float("inf")], [float(i % 7) for i in range(40)], np.random.default_rng(1).lognormal(size=300).tolist(), [0.0] * 50 + [9.0] * 50])
def test_statistics(spark, values):
    df = spark.createDataFrame([(1, v, i, 0.5, 5.0) for i, v in enumerate(values)], "t int, result double, id long, lo double, hi double")
    x = np.array([v for v in values if v is not None and np.isfinite(v)])
    rows = M.summary_stats(df, ["t"]).collect()
    assert len(rows) == (1 if len(x) else 0)
    if len(x):
        r = rows[0]
        assert (r["n"], r["min"], r["max"]) == (len(x), x.min(), x.max())
        assert [r["mean"], r["median"], r["std"]] == pytest.approx([x.mean(), np.median(x), x.std()], abs=1e-4)
        shape = M.classify_distribution(df, ["t"]).first()["shape"]
        assert shape == ("sparse" if len(x) < 8 else "degenerate" if x.std() == 0 else "discrete" if len(set(x)) <= max(5, 0.05 * len(x)) else shape)
        c = M.capabilities(df, ["t"]).first()
        if len(x) < 2 or x.std() == 0:
            assert c["cpk"] is None
        else:
            assert c["cpk"] == pytest.approx(min((x.mean() - 0.5), (5 - x.mean())) / (3 * x.std()), abs=1e-5)


def test_compare_equals_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 120), 3), np.round(rng.normal(1, 1, 75), 3)
    df = spark.createDataFrame([(1, "A", float(v)) for v in a] + [(1, "B", float(v)) for v in b] + [(2, "A", 1.0)] * 5 + [(2, "B", 1.0)] * 5 + [(3, "A", 1.0)] * 3 + [(3, "B", 1.0)] * 9, "t int, run string, result double")
    got = {r["t"]: r for r in M.compare_distributions(df, ["t"]).collect()}
    assert set(got) == {1, 2}
    grid = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 128)
    ks = max(abs((a[:, None] <= grid + 1e-9).mean(0) - (b[:, None] <= grid + 1e-9).mean(0)))
    ps = np.linspace(0.02, 0.98, 75)
    r2 = np.corrcoef(np.percentile(a, ps * 100), np.percentile(b, ps * 100))[0, 1] ** 2
    assert got[1]["ks"] == pytest.approx(ks, abs=1e-5) and got[1]["qq_r2"] == pytest.approx(r2, abs=1e-4)
    assert got[1]["shifted"] and got[2]["qq_r2"] == 1.0 and not got[2]["differs"]


def test_reach(spark):
    edges = spark.createDataFrame([(1, 1, 2, "a"), (2, 1, 2, "b"), (3, 2, 3, "a"), (4, 3, 1, "a"), (5, 2, 2, "s"), (6, 4, 1, "a"), (7, 1, None, "x")], "id long, src long, dst long, link_type string")
    start = spark.createDataFrame([(1,)], "start long")
    got = lambda *a, **k: {r["doc"]: (r["hops"], r["direction"], r["weight"], r["link_type"]) for r in G.reach(edges, start, *a, **k).collect()}
    assert got(0) == {2: (1, "out", 2, "a")}
    assert got(5) == {2: (1, "out", 2, "a"), 3: (2, "out", 0, "")}
    assert got(2, "both") == {2: (1, "both", 0, ""), 3: (1, "both", 0, ""), 4: (1, "in", 1, "a")}
    assert got(2, "both", fixed=True)[2] == (1, "both", 2, "a")


@pytest.mark.parametrize(("raw", "want"), [("b.html#x", "d/e/b.html"), ("../a.html?q=1", "d/a.html"), ("/r/s.md", "r/s.md"), ("./../../../x", "x"), ("mailto:a@b", None), ("//host/x", None), ("https://x/y", None), ("#top", None), ("?q", None)])
def test_link_target(spark, raw, want):
    df = spark.createDataFrame([(raw, "d/e/f.html")], "r string, p string")
    assert df.select(G.local_target(F.col("r"), F.col("p"))).first()[0] == want


@pytest.mark.parametrize(("cell", "want"), [("1_0", 10.0), ("5d", None), (" 2.5 ", 2.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("NaN", None), ("-", None), ("inf", None), ("1e999", None), (None, None), ("__1", None), ("0x1", None)])
def test_as_float(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(D.as_float(F.col("c"))).first()[0] == want


def test_column_kinds(spark):
    rows = [(str(i) if i % 10 else "bad", "ab"[i % 2], f"text {i}", None if i % 2 else "7") for i in range(100)]
    df = spark.createDataFrame(rows, "n string, c string, t string, h string")
    assert {r["name"]: r["kind"] for r in D.column_kinds(df).collect()} == {"n": "numeric", "c": "categorical", "t": "text", "h": "numeric"}
    assert D.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_insertion_yield(spark):
    rows = [(1, "FT", "", "a", 0), (2, "FT", "", "a", 1), (3, "FT", "", "b", 1), (4, "FT", "", "b", 0), (5, "QA", "", "a", 1), (5, "QA", "", "a", 1), (6, None, "L", "c", 1)]
    df = P.touchdowns(spark.createDataFrame(rows, "id long, insertion string, lot string, part_id string, passed int"))
    got = {r["insertion"]: (r["place"], r["units"], r["first_pass"], r["final_pass"], r["retested"]) for r in P.insertion_yield(df, ["lot"]).collect()}
    assert got == {"ft": (1, 2, 1, 1, 2), "qa": (2, 1, 1, 1, 0), "": (3, 1, 1, 1, 0)}


def test_upsert_and_allocation(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in K.upsert(old, new, ["k"], "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    items = spark.createDataFrame([(f, i) for f, n in (("a", 50), ("b", 5), ("c", 1)) for i in range(n)], "f string, i int")
    take = lambda n: {r["f"]: r["take"] for r in K.stratified_allocation(items, "f", n).collect()}
    assert take(2) == {"a": 1, "b": 1, "c": 0} and sum(take(20).values()) == 20 and take(500) == {"a": 50, "b": 5, "c": 1}


def test_results_do_not_depend_on_partitions(spark, sf):
    from lodestone.plans import measure as PM

    want = sorted(PM.audit_findings(spark, sf).collect(), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(PM.audit_findings(spark, sf).collect(), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vector_top_asks_every_query_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "SLAB", 16)
    x = np.random.default_rng(5).normal(size=(90, 4))
    x[40:60] = x[7]  # ties
    x[80] = 0
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "chunk_id bigint, vector array<double>").repartition(3)
    asked = v.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in R.vector_top(v, asked, 6).collect())
    n = np.linalg.norm(x, axis=1)
    want = []
    for q in range(0, 90, 5):
        sim = [round(float(x[q] @ x[c] / (n[q] * n[c])), 6) + 0.0 if n[q] * n[c] else 0.0 for c in range(90)]
        want += [(q, r + 1, c) for r, c in enumerate(sorted(range(90), key=lambda c: (-sim[c], c))[:6])]
    assert got == want


def test_vector_topk_asks_every_id_divisible_by_50(spark, sf):
    from lodestone.plans import retrieval as PR

    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query_id"] for r in PR.vector_topk(spark, sf).collect()} == {i for i in ids if i % 50 == 0}


def test_related_docs_depth2_equals_brute_force(spark, tmp_path):
    from lodestone.plans import corpus as PC

    rng = random.Random(3)
    items = [(o, n, rng.randrange(95, 206), rng.randrange(40, 61)) for o in range(60) for n in range(3)]
    docs = [(c, rng.choice([48, 49, 50, 51, 100, 200]), rng.choice([49, 50, 51, 52, 100])) for c in range(25)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(docs, "chunk_a bigint, doc_a bigint, doc_b bigint").write.parquet(f"{tmp_path}/conflict_pairs.parquet")
    off = PC.NODE_OFFSET
    edges = [(a, b, i, "conflict") for i, a, b in docs] + [(p + off, s + 2 * off, o * 10 + n, "part") for o, n, p, s in items]
    found = {}
    for way, es in (("out", edges), ("in", [(b, a, i, t) for a, b, i, t in edges])):
        for start in {x for a, b, *_ in edges for x in (a, b) if x % 50 == 0}:
            one = {b for a, b, *_ in es if a == start} - {start}
            two = {b for a, b, *_ in es if a in one} - one - {start}
            for d in one | two:
                direct = sorted((i, t) for a, b, i, t in es if (a, b) == (start, d)) if d in one else []
                found.setdefault((start, d), []).append((2 - (d in one), way, len(direct), direct[0][1] if direct else ""))
    want = {k: v[0] if len(v) == 1 else (min(x[0] for x in v), "both", 0, "") for k, v in found.items()}
    got = {(r["start"], r["doc"]): (r["hops"], r["direction"], r["weight"], r["link_type"]) for r in PC.related_docs_depth2(spark, str(tmp_path)).collect()}
    assert got == want and {2, 1} == {v[0] for v in want.values()} and any(v[3] == "part" for v in want.values())
    assert sum(r["weight"] for r in PC.link_counts(spark, str(tmp_path)).collect()) == len(edges)


@pytest.mark.parametrize(("counts", "want"), [({"code": 5, "data": 5, "doc": 4}, "code"), ({"code": 5, "doc": 5}, "document"), ({"code": 2, "data": 5, "doc": 4}, "data"), ({"code": 4, "data": 5, "doc": 5}, "document"), ({"data": 1}, "data"), ({}, "document")])
def test_store_type(spark, counts, want):
    df = spark.createDataFrame([(c, i) for c, i in counts.items()], "category string, n bigint")
    r = K.store_type(df).first()
    assert (r["store_type"], r["code"], r["data"], r["doc"]) == (want, *(counts.get(c, 0) for c in ("code", "data", "doc")))


def test_balanced_pick_falls_back_to_the_first_tests(spark):
    pick = lambda rows: [(r["pick"], r["test"], r["category"]) for r in M.balanced_pick(spark.createDataFrame(rows, "test int, s double, categories string"), "test", F.col("s"), 3).orderBy("pick").collect()]
    none = [(t, float(t), "" if t % 2 else None) for t in range(9, 0, -1)]
    assert pick(none) == [(1, 1, None), (2, 2, None), (3, 3, None)]
    assert pick([*none, (20, 1.0, "site")]) == [(1, 20, "site")]


def test_gallery_queries_have_the_cap_of_the_operator(spark, sf_oracle):
    from lodestone.plans import measure as PM
    from lodestone.plans import reports as PR

    assert PM.round_robin_pick(spark, sf_oracle).count() > 12
    assert PR.dashboard_gallery(spark, sf_oracle).count() > 20


def test_best_of_a_batch_of_queries(spark, monkeypatch):
    """In blocks of any size, with words that are common, rare, asked twice, asked by nobody or in no text; ties and a null id."""
    rng = random.Random(3)
    words = ["the"] * 40 + ["of"] * 12 + ["pin"] * 4 + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:100]] + [(5000, None), (None, "the w7 w7 w8 w9")]
    df = spark.createDataFrame(rows, "id long, text string")
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(60)] + [(90, "nowhere"), (91, "the"), (92, "w1 nowhere"), (93, "w7 w8 w9")]
    terms = R.query_terms(spark.createDataFrame(asked, "query_id int, text string"))
    post, size = R.postings(df), R.index_size(df)
    want = sorted(map(tuple, R.top(R.bm25(post, size, terms), 5, (F.desc("score"), F.asc_nulls_last("chunk_id"))).select("query_id", "rank", "chunk_id", "score").collect()), key=lambda x: x[:2])
    for chunks, queries, broadcast in ((65_536, 100_000, 200_000), (40, 17, 0)):
        monkeypatch.setattr(R, "CHUNKS", chunks)
        monkeypatch.setattr(R, "QUERIES", queries)
        monkeypatch.setattr(R, "BROADCAST_TERMS", broadcast)
        got = sorted(map(tuple, R.bm25_best(post, size, terms, 5).select("query_id", "rank", "chunk_id", "score").collect()), key=lambda x: x[:2])
        assert got == want
    assert R.bm25_best(post, size, terms.where("false"), 5).count() == R.bm25_best(post.where("false"), R.index_size(df.where("false")), terms, 5).count() == 0


def test_batch_makes_no_row_for_each_query_and_chunk(spark, tmp_path):
    from lodestone.plans import retrieval as PR

    spark.range(400).selectExpr("id", "concat('alpha beta gamma word', id) AS text").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.range(400).selectExpr("id AS doc_id", "concat('alpha beta gamma name', id) AS title").write.parquet(f"{tmp_path}/documents.parquet")
    df = PR.bm25_batch(spark, str(tmp_path))
    assert len(df.collect()) == 400 * 3

    def most(node) -> int:
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *map(most, inner)])

    assert most(df._jdf.queryExecution().executedPlan()) < 400 * 400 / 4
