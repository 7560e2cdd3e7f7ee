import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import quantiles as Q


def exact(values, percents):
    v = sorted(values)
    return [v[max(1, -(-p * len(v) // 100)) - 1] for p in percents]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.integers(1, 7), st.integers(4, 32))
def test_rank_error_stays_within_its_bound(values, parts, k):
    sketches = []
    for i in range(parts):
        s = Q.Sketch(k, 3)
        own = values[i::parts]
        for at in range(0, len(own), 11):
            s.add(np.array(own[at : at + 11]))
        sketches.append(s.blob())
    total = Q.Sketch(k, 3)
    for b in sketches:
        total.merge(b)
    assert total.n == len(values)
    ordered = np.sort(values)
    err = total.rank_error()
    for p, x in zip(Q.PERCENTS, total.percentiles(Q.PERCENTS)):
        want = max(1, -(-p * len(values) // 100))
        lo, hi = np.searchsorted(ordered, x, "left") + 1, np.searchsorted(ordered, x, "right")
        assert lo - err - 1 <= want <= hi + err + 1


def test_large_stream_has_small_error():
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=2_000_000)
    s = Q.Sketch()
    for part in np.array_split(x, 400):
        s.add(np.sort(part))
    assert s.rank_error() / s.n < 0.002
    ordered = np.sort(x)
    for p, v in zip(Q.PERCENTS, s.percentiles(Q.PERCENTS)):
        assert abs(np.searchsorted(ordered, v) / len(x) - p / 100) < 0.002
    assert sum(len(b[2]) for b in s.full) + s.n_loose < 12 * Q.K


def test_small_groups_are_exact_and_nulls_are_groups(spark):
    rows = [(i, None if i % 5 == 0 else i % 2, float(i % 37)) for i in range(500)]
    rows += rows[:50] + [(600, 1, float("nan")), (601, 1, float("inf")), (602, 1, None), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "id long, k int, v double").withColumn("n", __import__("pyspark").sql.functions.lit("clash")).repartition(7)
    got = {r["k"]: r for r in Q.percentiles(Q.sketches(df, ["k"], "v", "id"), ["k"]).collect()}
    assert set(got) == {None, 0, 1}
    for k in got:
        own = [v for i, kk, v in {r[0]: r for r in rows if r[0] is not None}.values() if kk == k and v is not None and math.isfinite(v)]
        assert got[k]["n"] == len(own) and got[k]["rank_error"] == 0
        assert [got[k][f"p{p:02d}"] for p in Q.PERCENTS] == exact(own, Q.PERCENTS)


def test_days_combine_to_spans(spark):
    rows = [(i, i % 3, i % 10, float(i * 7919 % 1009)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k int, day int, v double")
    daily = Q.sketches(df, ["k", "day"], "v", "id", k=64, b=4)
    whole = Q.percentiles(Q.merged(daily.where("day < 4"), ["k"], 64, 4), ["k"], k=64, b=4).collect()
    for r in whole:
        own = sorted(v for _, k, d, v in rows if k == r["k"] and d < 4)
        assert r["n"] == len(own)
        for p in Q.PERCENTS:
            at = (np.searchsorted(own, r[f"p{p:02d}"], "left") + np.searchsorted(own, r[f"p{p:02d}"], "right")) / 2
            assert abs(at - p * len(own) / 100) <= r["rank_error"] * len(own) + 2


def test_empty(spark):
    df = spark.createDataFrame([], "id long, k int, v double")
    assert Q.percentiles(Q.sketches(df, ["k"], "v", "id"), ["k"]).count() == 0


def test_bound_is_put_to_the_test(spark, sf_oracle):
    from pyspark.sql import functions as F

    from lodestone.llm import quantiles as Q

    got = Q.p1_bound_check(spark, sf_oracle)
    assert got.where("NOT within").count() == 0 and got.where(F.col("n") > 100).count() > 5  # more than 3 buffers of 32: collapsed
    days = Q.sketches(Q.table(spark, sf_oracle, "stdf_results"), ["test_num"], "result", "id", 32, 3)
    assert Q.percentiles(days, ["test_num"], k=32, b=3).where("rank_error > 0").count() > 5


def test_two_steps_of_merging(spark, monkeypatch, sf):
    from lodestone.llm import quantiles as Q

    one = {tuple(r) for r in Q.p1_percentiles(spark, sf).collect()}
    monkeypatch.setattr(Q, "FAN", 2)
    assert {tuple(r) for r in Q.p1_percentiles(spark, sf).collect()} == one
