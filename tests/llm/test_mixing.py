import numpy as np
import pytest

from lodestone.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    for key in (0, 5, 12345):
        assert sorted(M.feistel(x, np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_shards_are_unbiased():
    shares = np.array([0.5, 0.3, 0.15, 0.05])
    total = sum(M.shard_counts(i, 64, shares) for i in range(400))
    assert all(M.shard_counts(i, 64, shares).sum() == 64 for i in range(20))
    assert np.abs(total / total.sum() - shares).max() < 0.005


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats double")


def test_shares_and_caps(spark):
    docs = [(i, "big" if i % 10 < 8 else "mid", 30 + i % 90) for i in range(4000)] + [(5000 + i, "tiny", 50) for i in range(10)] + [(6000, None, 40), (6001, "big", 0), (6002, "other", 10), (None, "big", 10), (6003, "big", None)]
    counts = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").repartition(3).selectExpr("*", "1 AS block", "2 AS start", "3 AS times")
    t = _targets(spark, [("big", 0.5, 2.0), ("mid", 0.3, 3.0), ("tiny", 0.1, 4.0), ("absent", 0.1, 2.0)])
    selection, shares = M.mix(counts, t, total_tokens=200_000, block=64)
    s = {r["source"]: r for r in shares.collect()}
    assert s["absent"]["tokens_drawn"] == 0 and s["absent"]["shortfall"] == pytest.approx(0.1)
    assert s["tiny"]["tokens_drawn"] == 4 * 500
    assert s["big"]["tokens_drawn"] / s["mid"]["tokens_drawn"] == pytest.approx(5 / 3, rel=0.06)
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1)
    rows = selection.collect()
    tokens = {d: n for d, _, n in docs if d is not None}
    cap = {"big": 2, "mid": 3, "tiny": 4}
    for r in rows:
        assert 0 < r["tokens_drawn"] <= cap[r["source"]] * tokens[r["doc_id"]]
    assert sum(r["tokens_drawn"] for r in rows) == sum(r["tokens_drawn"] for r in s.values())
    again = {(r["doc_id"], r["tokens_drawn"]) for r in M.mix(counts.repartition(9), t, total_tokens=200_000, block=64)[0].collect()}
    assert again == {(r["doc_id"], r["tokens_drawn"]) for r in rows}


def test_streams_cover_each_source_once(spark):
    docs = [(i, f"s{i % 3}", 1 + i * 7 % 40) for i in range(500)]
    got = M.streams(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), buckets=8).collect()
    for s in ("s0", "s1", "s2"):
        own = sorted((r["start"], r["n_tokens"]) for r in got if r["source"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    selection, shares = M.mix(none, _targets(spark, [("a", 1.0, 2.0)]))
    assert selection.count() == 0 and shares.collect()[0]["tokens_drawn"] == 0
    selection, shares = M.mix(none, _targets(spark, []))
    assert selection.count() == 0 and shares.count() == 0


def test_largest_feasible_total_meets_every_share(spark):
    docs = [(i, "big", 100) for i in range(3000)] + [(10_000 + i, "small", 100) for i in range(150)] + [(20_000, "crumb", 1)]
    counts = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = _targets(spark, [("big", 0.6, 1.0), ("small", 0.3, 2.5), ("crumb", 0.05, 1.0), ("absent", 0.05, 1.0)])
    selection, shares = M.mix(counts, t, block=100)
    s = {r["source"]: r for r in shares.collect()}
    assert [s[x]["feasible"] for x in ("big", "small", "crumb", "absent")] == [True, True, False, False]
    assert 28_000 <= s["small"]["tokens_drawn"] <= 30_000  # two whole passes, not two and a half
    assert s["big"]["tokens_drawn"] / s["small"]["tokens_drawn"] == pytest.approx(2, rel=0.03)
    assert max(r["times_drawn"] for r in selection.collect() if r["source"] == "small") <= 2


def test_slots_are_numbered_through_groups_of_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 3)
    docs = [(i, "ab"[i % 2], 10) for i in range(2000)]
    counts = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    selection, _ = M.mix(counts, _targets(spark, [("a", 0.5, 1.0), ("b", 0.5, 1.0)]), total_tokens=19_000, block=10, slots=64)
    rows = selection.collect()
    assert all(r["times_drawn"] == 1 for r in rows) and len(rows) == 1900  # no slot twice
