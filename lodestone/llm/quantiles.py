"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch is a list of sorted buffers of at most ``k`` values; a full buffer carries a weight. Full
buffers are kept by level; when more than ``b`` of them exist, all those of the lowest level are merged
and collapse into one of the summed weight, which takes the values at evenly spaced weighted positions.
Sketches of partitions, days or runs merge by pooling their buffers and collapsing by the same rule, in
any tree. Each sketch carries the bound of its rank error: with C collapses whose outputs weigh W in
sum, a reported rank is off by at most (W - C - 1) / 2 + w_max (0 while nothing was collapsed: a group is exact
until more than ``b`` buffers of ``k`` values are full).

Nulls, NaN and infinities don't count. A null key is a group of its own. A row id counts once, a null id not at all. No rows,
no groups. Ties keep their multiplicity.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import finite, ship, table

K, B = 4096, 8
#: Partitions above which sketches of one key merge in two steps, so that no task folds more than about as many.
FAN = 64
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
_HEAD, _BUF = struct.Struct("<qqqi"), struct.Struct("<qii")


class Sketch:
    """n values in buffers (level, weight, sorted array); ``out_weight`` and ``collapses`` give the error bound."""

    def __init__(self, k: int = K, b: int = B) -> None:
        self.k, self.b, self.n, self.out_weight, self.collapses = k, b, 0, 0, 0
        self.full: list[list] = []
        self.loose: list[np.ndarray] = []
        self.n_loose = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._loose(values)

    def _loose(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            rest = np.sort(np.concatenate(self.loose))
            cut = len(rest) // self.k
            # strided slices of a sorted run: each buffer spans its whole range
            for i in range(cut):
                self.full.append([0, 1, rest[: cut * self.k][i::cut]])
            tail = rest[cut * self.k :]
            self.loose, self.n_loose = ([tail], len(tail)) if len(tail) else ([], 0)
            self._shrink()

    def _shrink(self) -> None:
        while len(self.full) > self.b:
            levels = sorted({x[0] for x in self.full})
            low = [x for x in self.full if x[0] == levels[0]]
            if len(low) == 1:
                low[0][0] = levels[1]
                continue
            weight = sum(x[1] for x in low)
            values = np.concatenate([x[2] for x in low])
            order = np.argsort(values, kind="stable")
            ranks = np.cumsum(np.repeat([x[1] for x in low], self.k)[order])
            at = np.arange(self.k, dtype=np.int64) * weight + (weight + 1 + (self.collapses & 1 if weight % 2 == 0 else 0)) // 2
            self.collapses += 1
            self.out_weight += weight
            self.full = [x for x in self.full if x[0] != levels[0]] + [[levels[0] + 1, weight, values[order][np.searchsorted(ranks, at)]]]

    def merge(self, blob: bytes) -> None:
        n, out_weight, collapses, count = _HEAD.unpack_from(blob)
        at = _HEAD.size
        self.n += n
        self.out_weight += out_weight
        self.collapses += collapses
        loose = []
        for _ in range(count):
            weight, level, size = _BUF.unpack_from(blob, at)
            values = np.frombuffer(blob, np.float64, size, at + _BUF.size)
            at += _BUF.size + 8 * size
            if level < 0:
                loose.append(values)
            else:
                self.full.append([level, weight, values])
        self._shrink()
        for x in loose:
            self._loose(x)

    def blob(self) -> bytes:
        loose = [np.sort(np.concatenate(self.loose))] if self.n_loose else []
        parts = [_HEAD.pack(self.n, self.out_weight, self.collapses, len(self.full) + len(loose))]
        for level, weight, values in [*self.full, *((-1, 1, x) for x in loose)]:
            parts += [_BUF.pack(weight, level, len(values)), np.ascontiguousarray(values, np.float64).tobytes()]
        return b"".join(parts)

    def rank_error(self) -> float:
        """Bound of the error of a rank, in rows."""
        return (self.out_weight - self.collapses - 1) / 2 + max(x[1] for x in self.full) if self.collapses else 0.0

    def percentiles(self, percents: tuple[int, ...]) -> list[float]:
        """For each p the smallest kept value whose cumulative weight reaches ceil(p n / 100)."""
        buffers = [(w, v) for _, w, v in self.full] + [(1, x) for x in self.loose]
        values = np.concatenate([v for _, v in buffers])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(np.repeat([w for w, _ in buffers], [len(v) for _, v in buffers])[order])
        want = [max(1, -(-p * self.n // 100)) for p in percents]
        return values[order][np.minimum(np.searchsorted(ranks, want), len(values) - 1)].tolist()


def of_blob(blob: bytes, k: int = K, b: int = B) -> Sketch:
    s = Sketch(k, b)
    s.merge(blob)
    return s


def _runs(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Row numbers at which a new key starts, 0 included; nulls equal nulls."""
    new = np.zeros(batch.num_rows - 1, bool)
    for c in batch.columns[:keys]:
        a, b = c.slice(1), c.slice(0, batch.num_rows - 1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _by_key(keys: int, names: list[str], begin: Callable, feed: Callable, end: Callable) -> Callable:
    """Fold rows sorted by their first ``keys`` columns, group by group, across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, state = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _runs(batch, keys)
            ends = [*starts[1:].tolist(), batch.num_rows]
            payload = batch.column(keys)
            first = tuple(c[0].as_py() for c in batch.columns[:keys])
            out, rows = [], []
            done_key = None
            for i, (s, e) in enumerate(zip(starts.tolist(), ends)):
                if i or first != held:
                    if state is not None:
                        if i:
                            rows.append(starts[i - 1])
                        else:
                            done_key = held_key
                        out.append(end(state))
                    state = begin()
                state = feed(state, payload, s, e)
            if out:
                cols = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:keys]]
                if done_key is not None:
                    cols = [pa.concat_arrays([a, b]) for a, b in zip(done_key, cols)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=names)
            at = int(starts[-1])
            held_key = [c.slice(at, 1) for c in batch.columns[:keys]]
            held = tuple(c[0].as_py() for c in held_key)
        if state is not None:
            yield pa.RecordBatch.from_arrays([*held_key, pa.array([end(state)], pa.binary())], names=names)

    return run


def _schema(df: DataFrame, keys: list[str], last: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), last])


def sketches(df: DataFrame, keys: list[str], value: str, row_id: str | None = None, k: int = K, b: int = B) -> DataFrame:
    """keys, sketch (binary): one sketch per group of keys. The only full shuffle spreads rows by their id (uniform,
    whatever the keys' skew), drops repeats of an id and sketches each partition; then sketches alone move by key."""
    ship(df.sparkSession)
    src = df.where(finite(F.col(value)))
    if row_id:
        src = src.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("__id"), *keys, F.col(value).cast("double").alias("__value")).dropDuplicates(["__id"])
    src = src.select(*keys, F.col(value if not row_id else "__value").cast("double").alias("__value")).sortWithinPartitions(*keys, "__value")

    def feed(s: Sketch, values: pa.Array, a: int, e: int) -> Sketch:
        s.add(values.slice(a, e - a).to_numpy())
        return s

    part = src.mapInArrow(_by_key(len(keys), [*keys, "sketch"], lambda: Sketch(k, b), feed, Sketch.blob), _schema(src, keys, "sketch binary"))
    return merged(part, keys, k, b)


def merged(parts: DataFrame, keys: list[str], k: int = K, b: int = B) -> DataFrame:
    """One sketch per group of keys out of any number of sketches (of partitions, days, ...)."""

    def feed(s: list | Sketch, blobs: pa.Array, a: int, e: int) -> list | Sketch:
        for i in range(a, e):
            blob = blobs[i].as_py()
            if isinstance(s, list):
                if not s:
                    s = [blob]  # a lone sketch passes as it is
                    continue
                s = of_blob(s[0], k, b)
            s.merge(blob)
        return s

    ship(parts.sparkSession)
    src = parts.select(*keys, "sketch")
    spread = -(-int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FAN)
    for by in ([*keys, "__part"], keys) if spread > 1 else (keys,):
        if len(by) > len(keys):
            src = src.select(*keys, F.pmod(F.spark_partition_id(), F.lit(spread)).alias("__part"), "sketch")
        src = src.select(*by, "sketch").repartition(*by).sortWithinPartitions(*by)
        src = src.mapInArrow(_by_key(len(by), [*by, "sketch"], list, feed, lambda s: s[0] if isinstance(s, list) else s.blob()), _schema(src, by, "sketch binary"))
    return src.select(*keys, "sketch")


def percentiles(sk: DataFrame, keys: list[str], percents: tuple[int, ...] = PERCENTS, k: int = K, b: int = B) -> DataFrame:
    """keys, n, rank_error (bound, as a share of n), one column per percent."""
    names = [f"p{p:02d}" for p in percents]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [of_blob(x, k, b) for x in batch.column(batch.num_columns - 1).to_pylist()]
            q = [x.percentiles(percents) for x in s]
            cols = [pa.array([x.n for x in s], pa.int64()), pa.array([x.rank_error() / x.n for x in s], pa.float64())]
            cols += [pa.array([x[i] for x in q], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keys, "n", "rank_error", *names])

    return sk.select(*keys, "sketch").mapInArrow(run, _schema(sk, keys, ", ".join(["n bigint", "rank_error double", *(f"{x} double" for x in names)])))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "stdf_results").withColumn("day", F.to_date("tested_at"))
    return sketches(df, ["test_num", "site", "day"], "result", "id")


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per test and site, over all days, out of the daily sketches."""
    keys = ["test_num", "site"]
    return percentiles(merged(daily(spark, sf), keys), keys)


def p1_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Per test, site and day."""
    return percentiles(daily(spark, sf), ["test_num", "site", "day"])


def p1_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of days out of the daily sketches: here calendar months."""
    keys = ["test_num", "site", "month"]
    d = daily(spark, sf).withColumn("month", F.trunc("day", "month"))
    return percentiles(merged(d, keys), keys)


def p1_bound_check(spark: SparkSession, sf: str, k: int = 32, b: int = 3) -> DataFrame:
    """Per test and site, with buffers so small that they collapse over and over: how many values, and whether the rank of each percentile is within the stated bound."""
    keys = ["test_num", "site"]
    raw = table(spark, sf, "stdf_results")
    days = sketches(raw.withColumn("day", F.to_date("tested_at")), [*keys, "day"], "result", "id", k, b)
    p = percentiles(merged(days, keys, k, b), keys, PERCENTS, k, b).select(F.col("test_num").alias("t"), F.col("site").alias("s"), "n", "rank_error", *(f"p{x:02d}" for x in PERCENTS))
    one = raw.where(finite(F.col("result")) & F.col("id").isNotNull()).select("id", *keys, "result").dropDuplicates(["id"])
    j = one.join(p, one["test_num"].eqNullSafe(p["t"]) & one["site"].eqNullSafe(p["s"]))
    below = [F.count_if(F.col("result") < F.col(f"p{x:02d}")).alias(f"b{x}") for x in PERCENTS]
    upto = [F.count_if(F.col("result") <= F.col(f"p{x:02d}")).alias(f"u{x}") for x in PERCENTS]
    c = j.groupBy(*keys).agg(F.count("*").alias("n"), F.max("n").alias("stated"), F.max("rank_error").alias("e"), *below, *upto)
    want = {x: F.greatest(F.lit(1), F.ceil(F.col("n") * x / 100)) for x in PERCENTS}
    ok = F.col("n") == F.col("stated")
    for x in PERCENTS:  # the ranks of a value are those from the first to the last of its ties
        away = F.greatest(F.col(f"b{x}") + 1 - want[x], want[x] - F.col(f"u{x}"), F.lit(0))
        ok &= (away <= F.col("e") * F.col("n") + 1e-6) & (F.col(f"u{x}") > F.col(f"b{x}"))
    return c.select(*keys, "n", ok.alias("within"))


def _sql(keys: str, extra: str = "") -> str:
    cols = ", ".join(f"min(CASE WHEN rn >= greatest(1, ({p} * n + 99) // 100) THEN result END) AS p{p:02d}" for p in PERCENTS)
    return f"""WITH one AS (SELECT DISTINCT ON (id) id, test_num, site, result{extra} FROM stdf_results
      WHERE result IS NOT NULL AND isfinite(result)),
    r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY result) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM one)
    SELECT {keys}, n, CAST(0 AS DOUBLE) AS rank_error, {cols} FROM r GROUP BY {keys}, n"""


QUERIES = {"p1_percentiles": p1_percentiles, "p1_daily": p1_daily, "p1_monthly": p1_monthly, "p1_bound_check": p1_bound_check}
#: Exact percentiles; the sketches equal them until B buffers of K values are full, as in the smaller test tables.
SQL = {
    "p1_percentiles": _sql("test_num, site"),
    "p1_daily": _sql("test_num, site, day", ", CAST(tested_at AS DATE) AS day"),
    "p1_bound_check": "SELECT test_num, site, count(*) AS n, true AS within FROM (SELECT DISTINCT ON (id) id, test_num, site FROM stdf_results WHERE result IS NOT NULL AND isfinite(result)) GROUP BY test_num, site",
    "p1_monthly": _sql("test_num, site, month", ", CAST(date_trunc('month', tested_at) AS DATE) AS month"),
}
