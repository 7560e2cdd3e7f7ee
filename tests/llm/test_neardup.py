import random
import re

from lodestone.llm import neardup as N


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return (set(zip(w, w[1:], w[2:])), len(w))


def brute(rows, j=0.6, least=25):
    one = {}
    for i, g, t in rows:
        if i is not None and t is not None:
            s, n = shingles(t)
            if n >= least:
                one[i] = (g, t, s)
    out = set()
    ids = sorted(one)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            ga, ta, sa = one[a]
            gb, tb, sb = one[b]
            if ga is not None and gb is not None and ga != gb and ta != tb and len(sa & sb) >= j * len(sa | sb) - 1e-12:
                out.add((a, b))
    return out


def texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Prüfung", "É", "2.5", "x_y"]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            w = rows[rng.randrange(len(rows))][2].split(" ")
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.sample(vocabulary, rng.randrange(1, 3))
        else:
            w = rng.choices(vocabulary, k=rng.choice([10, 24, 25, 40, 120, 400]))
        rows.append((i, rng.randrange(40), " ".join(w)))
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, "id long, document_id long, text string").withColumn("class", __import__("pyspark").sql.functions.lit(1)).repartition(5)
    return {tuple(r)[:2] for r in N.pairs_of(*N.similar_classes(df)).collect()}


def test_equals_brute_force(spark):
    rows = texts(300)
    rows += [(1000, 90, rows[5][2]), (1001, 91, rows[5][2].upper()), (1002, None, rows[5][2] + " x"), (None, 3, rows[5][2]), (1003, 4, None), (1004, 4, ""), (1005, 4, "  \n ")] + rows[:20]
    want = brute(rows)
    assert len(want) > 20
    assert found(spark, rows) == want


def test_copies_and_long_text(spark):
    base = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(i, i, "same words again " * 12) for i in range(200)] + [(300, 1, base), (301, 2, base + " tail")]
    assert found(spark, rows) == {(300, 301)}


def test_empty(spark):
    assert found(spark, []) == set()


def test_distance_is_a_lower_bound():
    import numpy as np

    from lodestone.llm.shingles import shingles as sh
    from lodestone.llm.shingles import words

    rows = texts(60, 9)
    s, d = sh(*words([t for _, _, t in rows]), 3)
    for level in (0, 1, 2):
        e = N.embed(s, d, len(rows), level)
        coarse = N.fold(e) if level else None
        for a in range(0, 60, 7):
            for b in range(60):
                apart = len(set(s[d == a].tolist()) ^ set(s[d == b].tolist()))
                assert int(np.bitwise_count(e[a] ^ e[b]).sum()) <= apart
                if coarse is not None:
                    assert int(np.bitwise_count(coarse[a] ^ coarse[b]).sum()) <= apart


def test_groups(spark):
    import pyspark.sql.functions as F

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (5, 5)], "a long, b long")
    nodes = spark.range(1, 13).select(F.col("id").alias("node"))
    got = {r["node"]: r["component"] for r in N.components(edges, nodes).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 10, 11, 12)] == [1, 1, 1, 1, 5, 10, 10, 12]


def test_hot_buckets_meet_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # one template with few edits: all share their prefix
        own = list(base)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, i, " ".join(own)))
    df = spark.createDataFrame(rows, "id long, document_id long, text string").repartition(3)
    pairs = lambda: {(r["class_a"], r["class_b"]) for r in N.similar_classes(df)[1].collect()}
    whole = pairs()
    monkeypatch.setattr(N, "CELL_ROWS", 15)
    monkeypatch.setattr(N, "SEEN", 2)
    members, sketch = N.classes(df, "id", "document_id")
    assert max(N.hot_buckets(df, sketch, 8, N.WORDS, N.MIN_WORDS, N.SIMILARITY).values()) > 2
    assert pairs() == whole and len(whole) > 100
