import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing as P


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bound_and_packing(sizes):
    at, fill = P.best_fit_decreasing(sizes, 50)
    got = defaultdict(int)
    for s, b in zip(sizes, at):
        got[b] += s
    assert [got[b] for b in range(len(fill))] == fill
    assert all(f <= 50 for f in fill)
    assert P.lower_bound(sizes, 50) <= len(fill) <= max(1, 1.23 * P.lower_bound(sizes, 50) + 1) or not sizes


def test_bound_beats_volume():
    assert P.lower_bound([26] * 10, 50) == 10  # by volume 6
    assert P.lower_bound([34, 34, 17, 17], 50) == 3


def _check(rows, items, capacity):
    assert sorted((r["doc_id"], r["piece"], r["size"]) for r in rows) == sorted(items)
    fill = defaultdict(int)
    for r in rows:
        fill[r["container"]] += r["size"]
    assert all(fill[r["container"]] == r["container_fill"] <= capacity for r in rows)
    return len(fill)


@pytest.mark.parametrize("part_items", [50, 20_000])
def test_table(spark, part_items):
    rng = random.Random(1)
    counts = [(i, rng.choice([3, 40, 90, 100, 101, 350])) for i in range(600)] + [(900, 0), (901, None), (None, 5), (902, -1)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens long")
    items = P.pieces(df, 100)
    want = [(i, p, min(100, n - 100 * p)) for i, n in counts if n and n > 0 and i is not None for p in range(-(-n // 100))]
    rows = P.pack(items, 100, part_items=part_items).collect()
    bins = _check(rows, want, 100)
    volume = -(-sum(s for *_, s in want) // 100)
    assert bins <= 1.15 * P.lower_bound([s for *_, s in want], 100) and bins >= volume
    assert {r["doc_id"] for r in rows if r["n_pieces"] > 1} == {i for i, n in counts if n and n > 100 and i is not None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert P.pack(P.pieces(df, 100), 100).count() == 0


def test_tokens(spark):
    from lodestone.llm.tokens import encoding, token_counts, VOCABULARY

    df = spark.createDataFrame([(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (4, "ä" * 3000)], "doc_id long, text string").withColumn("n_tokens", __import__("pyspark").sql.functions.lit("clash"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    e = encoding(VOCABULARY)
    assert got == {1: len(e.encode_ordinary("Hello <|endoftext|> world")), 2: 0, 3: 0, 4: len(e.encode_ordinary("ä" * 3000))}


def test_refill_keeps_items_and_reaches_the_bound():
    rng = random.Random(4)
    better = 0
    for _ in range(60):
        cap = 500
        sizes = [rng.choice([rng.randrange(1, 500), rng.randrange(60, 180)]) for _ in range(rng.randrange(1, 400))]
        at, fill = P.best_fit_decreasing(sizes, cap)
        new_at, new_fill = P.refill(sizes, cap, list(at), list(fill))
        got = [0] * len(new_fill)
        for i, b in enumerate(new_at):
            got[b] += sizes[i]
        assert got == new_fill and max(got) <= cap and P.lower_bound(sizes, cap) <= len(new_fill) <= len(fill)
        better += len(new_fill) < len(fill)
    assert better > 5
    assert P.refill([], 10, [], []) == ([], [])


def test_partitions_exchange_and_certify(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, 0, 1, rng.randrange(200, 520)) for i in range(3000)], "doc_id long, piece int, n_pieces int, size int")
    rows = P.pack(items, 1000, part_items=300).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) == 3000
    rounds = {r["container"].split("-")[0] for r in rows}
    assert len(rounds) > 1  # what a partition could not certify moved on
    easy = spark.createDataFrame([(i, 0, 1, 1 + i % 40) for i in range(3000)], "doc_id long, piece int, n_pieces int, size int")
    assert all(r["certified"] for r in P.pack(easy, 1000, part_items=300).collect())
