"""Filling fixed-capacity containers: bound-certified repacking.

Items (documents, or pieces of documents above the capacity) are spread by hash over partitions of
bounded size. Each partition packs its items by best-fit decreasing and computes a lower bound of its
number of bins from dual-feasible functions. Where the number meets the bound the packing is certified
optimal and stays. Elsewhere the items of bins with gaps are packed once more among themselves by subset sums;
if the bound is still missed, the well-filled bins stay and the items of the others are exchanged: they
are hashed anew over fewer partitions and packed again, for a fixed number of rounds. Only keys and
sizes are shuffled, never text; no partition holds more than about ``part_items`` items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, token_counts
from lodestone.session import cut, ship, table

ROUNDS, PART_ITEMS, FULL, CHOICE = 3, 20_000, 0.995, 64


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and the dual-feasible functions
    f_k(x) = x if (k+1)x is a multiple of C, else floor((k+1)x/C)*C/k, and of the threshold function
    that rounds sizes above C-e up to C, drops those below e and keeps the rest."""
    if not sizes:
        return 0
    best = -(-sum(sizes) // capacity)
    for k in (1, 2, 3, 4, 5, 7, 9, 14, 19):
        total = 0  # in units of C/k, kept whole by scaling with k
        for x in sizes:
            total += k * x if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity
        best = max(best, -(-total // (k * capacity)))
    for e in {capacity // d for d in (2, 3, 4, 6, 10)}:
        total = sum(capacity if x > capacity - e else x for x in sizes if x >= e)
        best = max(best, -(-total // capacity))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and the fill of each bin. Room is looked up in one bit set over residuals."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    at, fill = [0] * len(sizes), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i in order:
        s = sizes[i]
        above = bits >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                bits ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        at[i] = b
        fill[b] += s
        if r - s:
            open_bins[r - s].append(b)
            bits |= 1 << (r - s)
    return at, fill


def refill(sizes: list[int], capacity: int, at: list[int], fill: list[int], choice: int = CHOICE) -> tuple[list[int], list[int]]:
    """The items of all bins with gaps, packed again if that takes fewer bins: each new bin begins with the largest item left and takes the
    subset of ``choice`` items, evenly spread over the sizes left, that fills it best (subset sums in one bit set). Full bins stay."""
    open_ = [b for b, f in enumerate(fill) if f < capacity]
    if len(open_) < 2:
        return at, fill
    here = set(open_)
    left = sorted((i for i, b in enumerate(at) if b in here), key=lambda i: (-sizes[i], i))
    groups: list[list[int]] = []
    while left:
        own = [left.pop(0)]
        room = capacity - sizes[own[0]]
        step = max(1, len(left) // choice)
        some = [k for k in range(0, len(left), step) if sizes[left[k]] <= room]
        reach, steps, mask = 1, [], (1 << (room + 1)) - 1
        for k in some:
            steps.append(reach)
            reach |= (reach << sizes[left[k]]) & mask
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        taken = []
        for k, before in zip(reversed(some[: len(steps)]), reversed(steps)):
            if not before >> total & 1:
                taken.append(k)
                total -= sizes[left[k]]
        room -= sum(sizes[left[k]] for k in taken)
        own += [left[k] for k in taken]
        for k in sorted(taken, reverse=True):
            del left[k]
        if room:  # what fits of the smallest, of which the choice may have missed some
            for k in range(len(left) - 1, -1, -1):
                if sizes[left[k]] > room:
                    break
                room -= sizes[left[k]]
                own.append(left.pop(k))
        groups.append(own)
    if len(groups) >= len(open_):
        return at, fill
    keep = [b for b in range(len(fill)) if b not in here]
    number = {b: n for n, b in enumerate(keep)}
    new_at, new_fill = [number.get(b, -1) for b in at], [fill[b] for b in keep]
    for g in groups:
        for i in g:
            new_at[i] = len(new_fill)
        new_fill.append(sum(sizes[i] for i in g))
    return new_at, new_fill


def pieces(counts: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """key, piece, n_pieces, size: an item above the capacity is cut into full pieces and a rest, others
    stay whole. Items without size (null, 0 or less) need no room and get no row, nor do items without key."""
    n = F.ceil(F.col("n_tokens") / F.lit(float(capacity))).cast("int")
    return (
        counts.where((F.col("n_tokens") > 0) & F.col(key).isNotNull())
        .withColumn("n_pieces", n)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .select(key, "piece", "n_pieces", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * F.lit(capacity)).cast("int").alias("size"))
    )


def pack(items: DataFrame, capacity: int, key: str = "doc_id", rounds: int = ROUNDS, part_items: int = PART_ITEMS, full: float = FULL) -> DataFrame:
    """key, piece, n_pieces, size, container, container_fill, certified.

    ``container`` names round, partition and bin; ``certified`` says that the partition's number of
    bins equals its lower bound. Ties of size go by (key, piece), so a repeat gives the same result; an empty input
    gives no rows; keys may repeat across pieces only.
    """
    schema = f"`{key}` bigint, piece int, n_pieces int, size int, container string, container_fill int, certified boolean, stays boolean"
    ship(items.sparkSession)
    left, done = cut(items), None
    n = left.count()
    for r in range(rounds):
        parts = max(1, -(-n // part_items))
        last = r == rounds - 1 or n == 0

        packed = (
            left.withColumn("part", F.pmod(F.xxhash64(key, "piece", F.lit(r)), F.lit(parts)).cast("int"))
            .groupBy("part")
            .applyInPandas(_packer(key, capacity, r, last, full), schema)
        )
        if last:
            return _out(packed if done is None else done.unionByName(packed))
        packed = cut(packed)
        left = packed.where(~F.col("stays")).select(key, "piece", "n_pieces", "size")
        n = left.count()
        stays = packed.where("stays")
        done = stays if done is None else done.unionByName(stays)
        if n == 0:
            return _out(done)
    return _out(done)


def _packer(key: str, capacity: int, r: int, last: bool, full: float):
    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable")
        sizes = pdf["size"].tolist()
        at, fills = best_fit_decreasing(sizes, capacity)
        least = lower_bound(sizes, capacity)
        if len(fills) > least:
            at, fills = refill(sizes, capacity, at, fills)
        sure = len(fills) == least
        p = int(pdf["part"].iloc[0])
        pdf["container"] = [f"{r}-{p}-{b}" for b in at]
        pdf["container_fill"] = [fills[b] for b in at]
        pdf["certified"] = sure
        pdf["stays"] = [last or sure or fills[b] >= full * capacity for b in at]
        return pdf.drop(columns="part")

    return fill


def _out(df: DataFrame) -> DataFrame:
    return df.drop("stays")


def capacity_of(spark: SparkSession, sf: str, name: str) -> tuple[int, int]:
    """Capacity and overlap of a row of size_limits, a table of fixed size."""
    row = table(spark, sf, "size_limits").where(F.col("limit_name") == name).select("capacity", "overlap").first()
    return int(row[0]), int(row[1])


def packed(spark: SparkSession, sf: str, limit: str, vocabulary: str = VOCABULARY) -> DataFrame:
    cap, _ = capacity_of(spark, sf, limit)
    return pack(pieces(token_counts(table(spark, sf, "documents"), vocabulary=vocabulary), cap), cap)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing into the largest containers had to split."""
    return packed(spark, sf, "pack_large").where("n_pieces > 1").select("doc_id").distinct()


def p7_pack_medium(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document (or piece) and how full it is, for the medium capacity."""
    return packed(spark, sf, "pack_medium")


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """For each pack_* limit: items, containers, the least number any packing needs by volume, share of room used, containers of partitions that are certified optimal."""
    counts = cut(token_counts(table(spark, sf, "documents")))
    out = None
    for name in ("pack_small", "pack_medium", "pack_large"):
        cap, _ = capacity_of(spark, sf, name)
        one = pack(pieces(counts, cap), cap).agg(
            F.lit(name).alias("limit_name"),
            F.count("*").alias("items"),
            F.countDistinct("container").alias("containers"),
            F.ceil(F.sum("size") / F.lit(float(cap))).alias("volume_bound"),
            F.round(F.sum("size") / (F.countDistinct("container") * F.lit(float(cap))), 6).alias("fill"),
            F.countDistinct(F.when(F.col("certified"), F.col("container"))).alias("certified"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether packings of partitions as small as 500 items, so that they exchange, are whole: every document has its pieces once and all its tokens, no container
    is over its capacity, its fill is the sum of its items, and there are no fewer containers than the volume needs, nor 3 % and 50 more."""
    counts = cut(token_counts(table(spark, sf, "documents")))
    have = counts.where("n_tokens > 0").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))  # one row
    out = None
    for name in ("pack_medium", "pack_large"):
        cap, _ = capacity_of(spark, sf, name)
        rows = cut(pack(pieces(counts, cap), cap, part_items=500))
        per = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.countDistinct("piece").alias("d"), F.max("n_pieces").alias("n"), F.sum("size").alias("t"))
        per = per.agg(F.count("*").alias("pd"), F.sum("t").alias("pt"), F.bool_and(F.expr("k = n AND d = n")).alias("once"))
        bins = rows.groupBy("container").agg(F.sum("size").alias("s"), F.max("container_fill").alias("f"), F.min("container_fill").alias("g"))
        bins = bins.agg(F.count("*").alias("bins"), F.bool_and(F.col("s") <= cap).alias("within"), F.bool_and(F.expr("s = f AND f = g")).alias("stated"))
        name_ = F.lit(name).alias("limit_name")
        one = have.select(name_, "*").join(per.select(name_, "*"), "limit_name").join(bins.select(name_, "*"), "limit_name")  # one row each
        volume = F.ceil(F.col("tokens") / F.lit(float(cap)))
        one = one.select("limit_name", (F.col("once") & (F.col("pd") == F.col("docs")) & (F.col("pt") == F.col("tokens"))).alias("whole"), "within", "stated", ((F.col("bins") >= volume) & (F.col("bins") <= 1.03 * volume + 50)).alias("tight"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p7_found": p7_found, "p7_pack_medium": p7_pack_medium, "p7_fill": p7_fill, "p7_check": p7_check}
SQL = {"p7_check": "SELECT limit_name, true AS whole, true AS within, true AS stated, true AS tight FROM size_limits WHERE limit_name IN ('pack_medium', 'pack_large')"}
