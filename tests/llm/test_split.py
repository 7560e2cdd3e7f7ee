import itertools
import random

import numpy as np
import pytest

from lodestone.llm import split as S


def cost(starts, penalty, n, capacity, overlap):
    even = n / (1 + -(-(n - capacity) // (capacity - overlap)))
    ends = [*starts, n]
    return sum(penalty[i] for i in starts[1:]) + sum(((b - a) / even - 1) ** 2 for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    n, capacity = rng.randint(6, 12), rng.randint(3, 5)
    overlap = rng.randint(0, capacity - 1)
    p = np.array([rng.choice([0, 0.1, 0.5, 1.2]) for _ in range(n)])
    best = min(
        (cost([0, *c], p, n, capacity, overlap) for r in range(1, n) for c in itertools.combinations(range(1, n), r) if c[0] <= capacity and all(b - a <= capacity - overlap for a, b in zip(c, [*c[1:], n]))),
    )
    assert cost(S.cuts(p, capacity, overlap), p, n, capacity, overlap) == pytest.approx(best)


def check(text, pieces, capacity, overlap):
    words = S.WORD.findall(text)
    got = []
    for i, p in enumerate(pieces):
        own = S.WORD.findall(p["text"])
        assert len(own) == p["n_words"] <= capacity
        assert own == words[p["first_word"] : p["end_word"]]
        if i:
            assert p["first_word"] == max(0, p["new_from"] - overlap)
            assert p["new_from"] == pieces[i - 1]["end_word"]
        got += words[p["new_from"] : p["end_word"]]
    assert got == words


def test_round_trip_and_boundaries():
    text = "\n\n".join(f"Heading {i}\n" + " ".join(f"a{i}w{k}." if k % 9 == 0 else f"a{i}w{k}" for k in range(90)) for i in range(9))
    segs = [{"ord": i, "heading_path": f"A>{i}", "text": " ".join(f"a{i}w{k}." if k % 9 == 0 else f"a{i}w{k}" for k in range(90))} for i in range(9)]
    pieces = S.split_text(text, 350, 40, segs, "own")
    check(text, pieces, 350, 40)
    starts = {p["new_from"] % 92 for p in pieces}
    assert starts == {0}  # each cut lies before a heading
    assert pieces[1]["locator"].startswith("A > ")


def test_overlap_is_clamped_and_long_text():
    text = " ".join(f"w{i}" for i in range(20_000))
    check(text, S.split_text(text, 350, 40), 350, 40)
    check("a b c d e f", S.split_text("a b c d e f", 3, 9), 3, 2)
    assert S.split_text("one two", 3, 1) == []
    assert S.split_text("x" * 5000, 3, 1) == []


def test_white_space_is_unicode():
    assert len(S.WORD.findall("a b c d　e​f\x1cg")) == 5


def test_table(spark):
    long = " ".join(f"w{i}." for i in range(400))
    chunks = [(1, 10, "L", long, "x"), (1, 10, "L", long, "x"), (2, 11, None, " ".join(["w"] * 350), "x"), (3, None, None, long, None), (4, 12, None, None, None), (5, 12, None, "", None), (None, 12, None, long, None)]
    c = spark.createDataFrame(chunks, "id long, document_id long, locator string, text string, piece string")
    s = spark.createDataFrame([(1, 10, 0, None, "w0. w1. w2. w3. w4. w5. w6."), (1, 10, 1, "H>I", "w200. w201. w202. w203. w204. w205."), (1, 10, 1, "H>I", "w200. w201. w202. w203. w204. w205."), (None, None, None, None, None)], "chunk_id long, document_id long, ord int, heading_path string, text string")
    got = S.split_chunks(c, s, 350, 40).orderBy("chunk_id", "piece").collect()
    assert {r["chunk_id"] for r in got} == {1, 3}
    assert len([r for r in got if r["chunk_id"] == 1]) == 2
    assert [r["locator"] for r in got if r["chunk_id"] == 1] == ["H > I", "H > I"] or got[0]["locator"] in ("L", "H > I")
    assert S.split_chunks(c.limit(0), s.limit(0), 350, 40).count() == 0


def test_segments_with_one_opening_are_told_apart():
    opening = "The relay matrix is wired as shown here"
    a, b = opening + " for the first bank alone", opening + " for the second bank alone"
    words = f"{b} . {a}".split()
    got = S._segments_at(words, [{"text": a, "heading_path": "A"}])
    assert got == [(len(b.split()) + 1, len(words), "A")]
    got = S._segments_at(words, [{"text": b, "heading_path": "B"}, {"text": a, "heading_path": "A"}])
    assert [(x, h) for x, _, h in got] == [(0, "B"), (len(b.split()) + 1, "A")]
    changed = S._segments_at(words, [{"text": a.replace("alone", "only"), "heading_path": "A"}])  # most of it stands there
    assert changed[0][0] == len(b.split()) + 1
    assert S._segments_at(words, [{"text": "The other text has nothing of this", "heading_path": "C"}]) == []
