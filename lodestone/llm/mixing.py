"""Mixing sources to target weights.

The documents of a source, in a pseudorandom order, form one stream of tokens that is cut into blocks of
fixed length. The output is shards of slots, one block each; a shard draws how many slots go to each
source (the whole parts of share x slots are fixed, the rest is drawn multinomially, so shares are
unbiased and vary little). The slots of a source are numbered through all shards; slot g takes block
perm(g mod blocks) of pass g div blocks, where perm is a keyed Feistel permutation, so a pass uses each
block once. A source may give at most floor(max_repeats) passes, as a part of another would repeat some documents more often
than allowed; slots beyond stay empty and show as a shortfall. Blocks and documents are joined by (source, block).

By default the total is the largest at which no cap is met, so that every source reaches its share. A source that
can't serve its share even of a total of GIVE_UP times the tokens that the sources hold (one without tokens, say) doesn't lower
the total: it gives what it may, the others keep their proportions, and it is reported as infeasible.

Null ids, null sources, sources without target and texts without tokens take no part. A source without documents
is reported with nothing drawn. Copies under other ids count as documents of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, token_counts
from lodestone.session import cut, ship, table

BLOCK, SLOTS, GROUP, BUCKETS, BUCKET_DOCS, GIVE_UP, SEED = 512, 256, 4096, 64, 1_000_000, 0.01, 17


def feistel(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A permutation of 0..n-1 for each key, by cycle walking over the next power of four. Arrays of equal length."""
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(rounds):
                f = (right + k + np.uint64(r * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0x94D049BB133111EB)
                left, right = right, (left ^ (f >> np.uint64(29))) & m
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def shard_counts(shard: int, slots: int, shares: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Slots of a shard by source: whole parts fixed, the rest drawn multinomially."""
    whole = np.floor(shares * slots + 1e-9).astype(np.int64)
    rest = np.maximum(shares * slots - whole, 0)
    left = slots - int(whole.sum())
    if left > 0:
        whole += np.random.default_rng([seed, shard]).multinomial(left, rest / rest.sum() if rest.sum() > 0 else shares)
    return whole


def streams(counts: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, start: where a document begins in its source's stream. Prefix sums in two levels, so
    no window holds more than a bucket of a source."""
    d = counts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)))
    inner = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s")).select("source", "bucket", F.coalesce(F.sum("s").over(outer), F.lit(0)).alias("base"))
    d = d.withColumn("before", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return d.join(sums.hint("merge"), ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). ``counts``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats, a table of
    few rows, one for each source, which is collected. ``total_tokens``: size to aim at, by default the largest that the caps allow.
    selection: doc_id, source, n_tokens, tokens_drawn, times_drawn. shares: source, target_share, max_repeats, available, feasible, tokens_drawn, actual_share, shortfall."""
    spark = counts.sparkSession
    ship(spark)
    counts, targets = counts.select("doc_id", "source", "n_tokens").where("doc_id IS NOT NULL"), targets.select("source", "target_share", "max_repeats")
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas().sort_values("source")
    small = spark.createDataFrame([(s, float(p), float(m)) for s, p, m in t.itertuples(index=False)], "source string, target_share double, max_repeats double")
    counts = cut(counts.where("n_tokens > 0 AND source IS NOT NULL").join(F.broadcast(small.select("source")), "source", "left_semi"))
    held_rows = counts.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()  # one row for each source of targets
    have = {r[0]: int(r[1]) for r in held_rows}
    buckets = max([BUCKETS, *(-(-int(r[2]) // BUCKET_DOCS) for r in held_rows)])
    shares = t["target_share"].to_numpy() / max(t["target_share"].sum(), 1e-12)
    names = t["source"].tolist()
    if not names:
        return spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, tokens_drawn bigint, times_drawn double"), spark.createDataFrame([], "source string, target_share double, max_repeats double, available bigint, feasible boolean, tokens_drawn bigint, actual_share double, shortfall double")
    blocks = np.array([-(-have.get(s, 0) // block) for s in names], np.int64)
    passes = np.floor(t["max_repeats"].fillna(1).to_numpy()).astype(np.int64)
    cap = blocks * passes
    full = np.array([have.get(s, 0) // block for s in names], np.int64)  # the last block of a source may be short
    most = np.floor(np.maximum(full, np.minimum(blocks, 1)) * passes / shares).astype(np.int64)  # slots of the whole output at which the cap is met
    feasible = most * block >= GIVE_UP * sum(have.values()) if sum(have.values()) else np.zeros(len(names), bool)
    n_slots = max(1, total_tokens // block if total_tokens else int(most[feasible].min()) if feasible.any() else 1)

    def draw(it):
        for pdf in it:
            for i in pdf["id"]:
                c = shard_counts(int(i), int(min(slots, n_slots - i * slots)), shares, seed)
                yield pd.DataFrame({"shard": int(i), "s": np.arange(len(names), dtype=np.int32), "n": c})

    drawn = spark.range(-(-n_slots // slots)).mapInPandas(draw, "shard bigint, s int, n bigint").withColumn("grp", F.floor(F.col("shard") / GROUP))
    w = Window.partitionBy("s", "grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("s").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # a row for GROUP shards
    first = drawn.groupBy("s", "grp").agg(F.sum("n").alias("g")).select("s", "grp", F.coalesce(F.sum("g").over(over), F.lit(0)).alias("first"))
    drawn = drawn.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).join(first, ["s", "grp"]).select("shard", "s", "n", (F.col("base") + F.col("first")).alias("base")).where("n > 0")

    def place(it):
        for pdf in it:
            cuts = np.flatnonzero(np.diff(np.cumsum(pdf["n"].to_numpy()) // 1_000_000)) + 1  # about a million slots at once
            for part in np.split(np.arange(len(pdf)), cuts):
                n, first = pdf["n"].to_numpy()[part], pdf["base"].to_numpy(np.int64)[part]
                s = np.repeat(pdf["s"].to_numpy()[part], n)
                g = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(s))
                keep = g < cap[s]
                s, g = s[keep], g[keep]
                nb = blocks[s]
                at = feistel(g % nb, nb, (g // nb) * 1000 + s + seed) if len(g) else g
                yield pd.DataFrame({"source": pd.Series([names[i] for i in s], dtype="object"), "block": at})

    times = drawn.repartition("s", "shard").mapInPandas(place, "source string, block bigint").groupBy("source", "block").agg(F.count("*").alias("times"))
    docs = streams(counts, buckets, seed)
    pieces = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block))))
    pieces = pieces.withColumn("part", F.least(F.col("start") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    selection = (
        pieces.join(times.hint("merge"), ["source", "block"])
        .groupBy("doc_id", "source")
        .agg(F.max("n_tokens").alias("n_tokens"), F.sum(F.col("part") * F.col("times")).alias("tokens_drawn"))
        .withColumn("times_drawn", F.col("tokens_drawn") / F.col("n_tokens"))
    )
    got = selection.groupBy("source").agg(F.sum("tokens_drawn").alias("tokens_drawn"))
    held = spark.createDataFrame([(s, have.get(s, 0), bool(f)) for s, f in zip(names, feasible)], "source string, available bigint, feasible boolean")
    report = small.join(F.broadcast(held), "source").join(got, "source", "left").withColumn("tokens_drawn", F.coalesce("tokens_drawn", F.lit(0)))
    everything = F.sum("tokens_drawn").over(Window.partitionBy(F.lit(0)))  # one row for each source
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_drawn").cast("double"), everything.cast("double")), F.lit(0.0))).withColumn("shortfall", F.greatest(F.lit(0.0), F.col("target_share") - F.col("actual_share")))
    return selection, report


def _inputs(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    docs = table(spark, sf, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a table of fixed size
    return token_counts(docs, keep=("source",), vocabulary=vocabulary), targets


def p8_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn documents, how often, with the share their source reached."""
    selection, report = mix(*_inputs(spark, sf))
    selection = cut(selection)
    got = selection.groupBy("source").agg(F.sum("tokens_drawn").alias("source_tokens"))  # one row for each source
    got = got.withColumn("source_share", F.col("source_tokens") / F.sum("source_tokens").over(Window.partitionBy(F.lit(0))))
    return selection.join(F.broadcast(got), "source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix(*_inputs(spark, sf))[1]


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: whether its share is reached within 1 % of all and the room of a block for each source (or it is reported as infeasible and short), and no document is drawn more often than allowed."""
    selection, report = mix(*_inputs(spark, sf))
    most = selection.groupBy("source").agg(F.max("times_drawn").alias("most"))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    goal = F.col("target_share") / F.sum(F.when(F.col("feasible"), F.col("target_share"))).over(every)
    room = 0.01 + BLOCK * F.count("*").over(every) / F.sum("tokens_drawn").over(every)
    r = report.join(most, "source", "left").withColumn("met", F.when(F.col("feasible"), F.abs(F.col("actual_share") - goal) <= room).otherwise(F.col("shortfall") > 0))
    return r.select("source", "met", (F.coalesce("most", F.lit(0.0)) <= F.col("max_repeats") + 1e-9).alias("capped"))


QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares, "p8_check": p8_check}
SQL = {"p8_check": "SELECT source, true AS met, true AS capped FROM mix_targets WHERE target_share > 0"}
