"""Near-duplicate chunks with small edits: segment-popcount embedding, range join under Manhattan distance, exact check.

A text's fingerprint is its set of 64-bit shingle hashes. The embedding has m segments (m a power of two,
two to four times the number of shingles, so texts of one grid level share it); the coordinate of a segment is
the number of shingles that fall into it, counted up to one. The Manhattan distance of two embeddings is
then a popcount of an XOR, and never more than the number of shingles found in only one of the texts,
which a similarity of at least j bounds by (a + b)(1 - j)/(1 + j). A finer level folds into the next.

A distance this wide (a quarter of all shingles at 0.6) makes a grid over the segments alone admit nearly
every pair, so the grid has one more coordinate: a shingle of the prefix, i.e. of the rarest a - ceil(j a) + 1
shingles, of which two similar texts share one whatever the order, as long as it's the same for all. The
order comes from a count sketch of fixed size over the whole corpus. Cells are (shingle, level); a cell joins with its
own and the next levels. What passes the distance is verified on the texts.

Texts of equal shingle sets form a class; only one of a class takes part, so copies cost nothing. Null and
short texts take no part; repeated rows of an id count once. Nothing is capped: a bucket with a cell of more than CELL_ROWS
texts, as one shingle of very many texts makes, is cut into parts that meet two by two in tasks of their own.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.pairs import expand
from lodestone.llm.shingles import shingles, words
from lodestone.session import cut, ship, table

WORDS, SIMILARITY, MIN_WORDS = 3, 0.6, 25
SKETCH_BITS, SKETCH_PARTS, FILTER_BITS, LEVELS, BUCKET_BYTES, CELL_ROWS, SEEN, PAIRS_AT_ONCE = 20, 16, 23, 7, 32 << 20, 20_000, 16, 2_000_000


def _slices(texts: list[str], chars: int = 1_500_000) -> Iterator[tuple[int, list[str]]]:
    at, size, start = 0, 0, 0
    for at, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, texts[start : at + 1]
            start, size = at + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _sets(texts: list[str], size: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of the texts of enough words, shingles, number of the text of each among them, shingles of each)."""
    for start, part in _slices(texts):
        h, of = words(part)
        s, d = shingles(h, of, size)
        enough = np.bincount(of, minlength=len(part)) >= least
        keep = enough[d]
        s, d = s[keep], d[keep]
        at = np.unique(d)
        n = np.bincount(d, minlength=len(part))[at]
        yield at + start, s, np.repeat(np.arange(len(at)), n), n


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _slot(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(9)) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def classes(chunks: DataFrame, key: str, group: str, size: int = WORDS, least: int = MIN_WORDS) -> tuple[DataFrame, np.ndarray]:
    """(table of texts of enough words, count sketch). The table: id, grp, text_hash, class (hash of the shingle set), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            ids, groups, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()
            for at, s, _, n in _sets(texts, size, least):
                total += np.bincount(_slot(s), minlength=len(total))
                ends = np.cumsum(n)
                raw = s.tobytes()
                cls = [_digest(raw[8 * (e - k) : 8 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                th = [_digest(texts[i].encode("utf-8", "surrogatepass")) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([groups[i] for i in at], pa.int64()), pa.array(th), pa.array(cls), pa.array(n.astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=names)
        if total.any():
            parts = [zlib.compress(p.astype(np.int32).tobytes(), 1) for p in np.split(total, SKETCH_PARTS)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["id", "grp", "text_hash", "class", "n", "part", "sketch"]
    src = chunks.where(F.length("text") > 2 * least - 2).select(F.col(key).cast("bigint").alias("id"), F.col(group).cast("bigint").alias("grp"), "text").where("id IS NOT NULL")
    out = cut(src.mapInArrow(run, "id bigint, grp bigint, text_hash bigint, class bigint, n int, part int, sketch binary"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in pdf["sketch"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "sketch": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    got = {r[0]: r[1] for r in out.where("part IS NOT NULL").select("part", "sketch").groupBy("part").applyInPandas(add, "part int, sketch binary").collect()}  # SKETCH_PARTS rows, 4 MB in all
    sketch = np.concatenate([np.frombuffer(got[p], np.int32) if p in got else np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int32) for p in range(SKETCH_PARTS)])
    return out.where("part IS NULL").select("id", "grp", "text_hash", "class", "n").dropDuplicates(["id"]), sketch


def _level(n: np.ndarray) -> np.ndarray:
    """Grid level by number of shingles: up to 64, 128, 256, ..."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 64)), 0, LEVELS - 1).astype(np.int8)


def embed(s: np.ndarray, of: np.ndarray, count: int, level: int) -> np.ndarray:
    """Coordinates of ``count`` texts over 128 << level segments, packed: 2 << level words of 64 bits each."""
    m = 128 << level
    seg = ((s >> np.uint64(33)) & np.uint64(m - 1)).astype(np.int64)
    bits = np.zeros((count, m), np.uint8)
    bits[of, seg] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def fold(e: np.ndarray) -> np.ndarray:
    """The embedding over half as many segments."""
    half = e.shape[1] // 2
    return e[:, :half] | e[:, half:]


def hot_buckets(chunks: DataFrame, sketch: np.ndarray, buckets: int, size: int, least: int, j: float) -> dict[int, int]:
    """The number of parts of each bucket that has a cell of more than CELL_ROWS texts, of which there are no more than all postings / CELL_ROWS. Counted by a
    pass of its own over the texts, in which a cell of fewer than SEEN texts of some thousand doesn't count; it steers the work, not the result."""
    n = postings(chunks, sketch, buckets, size, least, j, None).groupBy("bucket", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > CELL_ROWS)
    return {r[0]: int(-(-r[1] // CELL_ROWS)) for r in n.groupBy("bucket").agg(F.max("n")).collect()}


def postings(chunks: DataFrame, sketch: np.ndarray, buckets: int, size: int, least: int, j: float, hot: dict[int, int] | None) -> DataFrame:
    """bucket, i, j, blob: for each bucket of shingles the texts with a prefix shingle in it, with their embedding, once each. A ``hot`` bucket is cut into
    parts by class, and each two parts meet under (i, j); elsewhere both are 0. Without ``hot`` only counts: bucket, cell, n."""
    sent = chunks.sparkSession.sparkContext.broadcast((sketch, hot))  # fixed size, and a number for each hot bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counts, hot), seen = sent.value, set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for _, s, of, n in _sets(texts, size, least):
                raw, ends = s.tobytes(), np.cumsum(n)
                cls = np.array([_digest(raw[8 * (e - k) : 8 * e]) for e, k in zip(ends.tolist(), n.tolist())], np.int64)
                fresh = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if not fresh.any():
                    continue
                keep = fresh[of]
                s, of, cls, n = s[keep], (np.cumsum(fresh) - 1)[of[keep]], cls[fresh], n[fresh]
                order = np.lexsort((s, counts[_slot(s)], of))
                rank = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                prefix = n - np.ceil(j * n - 1e-9).astype(np.int64) + 1
                chosen = rank < prefix[of]
                ps, po = s[order][chosen], of[chosen]
                bucket = (ps >> np.uint64(48)).astype(np.int64) % buckets
                if hot is None:
                    cell, load = np.unique(ps, return_counts=True)
                    cell, load = cell[load >= SEEN], load[load >= SEEN]
                    yield pa.RecordBatch.from_arrays([pa.array(((cell >> np.uint64(48)).astype(np.int64) % buckets).astype(np.int32)), pa.array(cell.view(np.int64)), pa.array(load.astype(np.int64))], names=["bucket", "cell", "n"])
                    continue
                level = _level(n)
                emb: dict[int, np.ndarray] = {}
                row_in = np.zeros(len(n), np.int64)
                for lv in np.unique(level):
                    mine = np.flatnonzero(level == lv)
                    row_in[mine] = np.arange(len(mine))
                    sel = level[of] == lv
                    emb[int(lv)] = embed(s[sel], row_in[of[sel]], len(mine), int(lv))
                order = np.lexsort((po, bucket))
                ps, po, bucket = ps[order], po[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                out = []
                for k in range(buckets):
                    o = po[edges[k] : edges[k + 1]]
                    if not len(o):
                        continue
                    texts_here, per = np.unique(o, return_counts=True)
                    keys = (ps[edges[k] : edges[k + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    parts = hot.get(k, 1)
                    part = cls[texts_here].view(np.uint64) % np.uint64(parts)
                    for i in np.unique(part).tolist():
                        mine = part == i
                        t, lv = texts_here[mine], level[texts_here[mine]]
                        blob = {
                            "cls": cls[t], "n": n[t].astype(np.int32), "level": lv, "per": per[mine].astype(np.int32), "keys": keys[np.repeat(mine, per)], "part": np.full(len(t), i, np.int32),
                            "emb": {int(x): emb[int(x)][row_in[t[lv == x]]] for x in np.unique(lv)},
                        }
                        raw = pickle.dumps(blob, protocol=5)
                        out += [(k, min(i, other), max(i, other), raw) for other in range(parts)]
                for at in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 64]), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "i", "j", "blob"])

    src = chunks.where(F.length("text") > 2 * least - 2).select("text")
    return src.mapInArrow(run, "bucket int, cell bigint, n bigint" if hot is None else "bucket int, i int, j int, blob binary")


def candidates(pdf: pd.DataFrame, j: float) -> pd.DataFrame:
    """Pairs of classes of one bucket, or of two parts of one, within the distance."""
    blobs = [pickle.loads(x) for x in pdf["blob"]]
    cls, n, level, per, part = (np.concatenate([b[k] for b in blobs]) for k in ("cls", "n", "level", "per", "part"))
    two = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    keys = np.concatenate([b["keys"] for b in blobs])
    row_in = np.zeros(len(cls), np.int64)
    emb: dict[int, np.ndarray] = {}
    for lv in np.unique(level):
        emb[int(lv)] = np.concatenate([b["emb"][int(lv)] for b in blobs if int(lv) in b["emb"]])
        row_in[level == lv] = np.arange(int((level == lv).sum()))
    of = np.repeat(np.arange(len(cls)), per)
    # the same class out of several tasks: its first row stays
    _, first, inverse = np.unique(cls, return_index=True, return_inverse=True)
    lone = first[inverse[of]] == of
    keys, of = keys[lone], of[lone]
    order = np.lexsort((n[of], keys))
    keys, of = keys[order], of[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(start, len(keys)))
    end = np.repeat(start + size, size)
    # rows are by size within a cell, so partners of a row are those behind it up to n / j
    sizes = n[of].astype(np.int64)
    later = end - np.arange(len(keys)) - 1
    rows = np.flatnonzero(later > 0)
    folded = {lv: fold(e) for lv, e in emb.items() if lv}
    share = (1 - j) / (1 + j)
    found, at = [], 0
    reach = np.cumsum(later[rows])
    while at < len(rows):
        base = reach[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(reach, base + PAIRS_AT_ONCE, side="right")))
        r, c = rows[at:to], later[rows[at:to]]
        a = np.repeat(r, c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        near = sizes[a] >= j * sizes[b] - 1e-9
        if two:  # pairs within a part meet elsewhere
            near &= part[of[a]] != part[of[b]]
        a, b = of[a[near]], of[b[near]]
        la, lb = level[a], level[b]
        limit = (n[a].astype(np.int64) + n[b]) * share + 1e-6
        for lv in np.unique(la):
            for step in (0, 1):
                sel = np.flatnonzero((la == lv) & (lb == lv + step))
                if len(sel):
                    x = emb[int(lv)][row_in[a[sel]]]
                    y = (folded[int(lv) + 1] if step else emb[int(lv)])[row_in[b[sel]]]
                    ok = sel[np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit[sel]]
                    ca, cb = cls[a[ok]], cls[b[ok]]
                    found.append(np.unique(np.stack([np.minimum(ca, cb), np.maximum(ca, cb)], axis=1), axis=0))
        at = to
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"class_a": pairs[:, 0], "class_b": pairs[:, 1]})


def _jaccard(a: list[str], b: list[str], size: int) -> np.ndarray:
    s, d = shingles(*words(a + b), size)
    n, k = np.bincount(d, minlength=2 * len(a)), len(a)
    order = np.lexsort((s, d % k))
    s, d = s[order], (d % k)[order]
    both = np.bincount(d[1:][(s[1:] == s[:-1]) & (d[1:] == d[:-1])], minlength=k)
    return both / np.maximum(n[:k] + n[k:] - both, 1)


def _needed(ids: DataFrame, key: str) -> np.ndarray:
    """A filter of fixed size over the ids: bits of their hashes. Passes more than the ids, never fewer."""

    def bits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = np.zeros(1 << FILTER_BITS, bool)
        for pdf in it:
            got[pdf["h"].to_numpy()] = True
        yield pd.DataFrame({"bits": [zlib.compress(np.packbits(got).tobytes(), 1)]})

    h = ids.select(F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).alias("h")).distinct().repartition(4).mapInPandas(bits, "bits binary")
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in h.collect():  # 4 rows of at most 1 MB
        out |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return out


def similar_classes(chunks: DataFrame, key: str = "id", group: str = "document_id", size: int = WORDS, j: float = SIMILARITY, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: id, grp, text_hash, class, n. pairs: class_a < class_b, similarity >= j, verified."""
    ship(chunks.sparkSession)
    members, sketch = classes(chunks, key, group, size, least)
    rep = cut(members.groupBy("class").agg(F.min("id").alias("rep")))
    buckets = max(8, math.ceil(rep.count() * 90 * 8 / BUCKET_BYTES))
    hot = hot_buckets(chunks, sketch, buckets, size, least, j)
    found = postings(chunks, sketch, buckets, size, least, j, hot).groupBy("bucket", "i", "j").applyInPandas(lambda pdf: candidates(pdf, j), "class_a bigint, class_b bigint").distinct()
    r = [rep.select(F.col("class").alias(f"class_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab"]
    found = cut(found.join(r[0], "class_a").join(r[1], "class_b"))
    ids = found.select(F.col("rep_a").alias("id")).union(found.select("rep_b"))
    wanted = chunks.sparkSession.sparkContext.broadcast(_needed(ids, "id"))  # fixed size

    def some(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in it:
            h = b.column(2).to_numpy()
            yield b.filter(pa.array((bits[h >> 3] >> (7 - (h & 7))) & 1 == 1))

    texts = chunks.where(F.length("text") > 2 * least - 2).select(F.col(key).cast("bigint").alias("id"), "text", F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(1 << FILTER_BITS)).alias("h"))
    texts = texts.mapInArrow(some, "id bigint, text string, h bigint").drop("h").dropDuplicates(["id"])
    ta, tb = (texts.select(F.col("id").alias(f"rep_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                sim = _jaccard(p.column(2).to_pylist(), p.column(3).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(sim)], names=["class_a", "class_b", "similarity"]).filter(pa.array(sim >= j - 1e-12))

    pairs = found.join(ta, "rep_a").join(tb, "rep_b").select("class_a", "class_b", "text_a", "text_b").mapInArrow(verify, "class_a bigint, class_b bigint, similarity double")
    return members, pairs


def _body(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where("kind = 'body'").select("id", "document_id", "text")


def pairs_of(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunk_a < chunk_b of different groups and different texts, with their similarity. Texts meet once, and are spread to their chunks in parts of bounded size."""
    texts = members.select("class", "text_hash").distinct()
    mixed = texts.groupBy("class").agg(F.count("*").alias("k")).where("k > 1").select("class")
    a, b = (texts.select(F.col("class").alias(f"class_{x}"), F.col("text_hash").alias(f"text_hash_{x}")) for x in "ab")
    own = a.join(mixed.select(F.col("class").alias("class_a")), "class_a", "left_semi").join(b.withColumnRenamed("class_b", "class_a"), "class_a").where("text_hash_a < text_hash_b")
    own = own.select("class_a", "text_hash_a", F.col("class_a").alias("class_b"), "text_hash_b", F.lit(1.0).alias("similarity"))
    other = pairs.join(a, "class_a").join(b, "class_b").where("text_hash_a <> text_hash_b").select("class_a", "text_hash_a", "class_b", "text_hash_b", "similarity")
    found = cut(other.unionByName(own))
    every = expand(members.select("class", "text_hash", "id", "grp"), found, ["class", "text_hash"], ["id", "grp"]).where("grp_a <> grp_b")
    return every.select(F.least("id_a", "id_b").alias("chunk_a"), F.greatest("id_a", "id_b").alias("chunk_b"), "similarity").dropDuplicates(["chunk_a", "chunk_b"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    members, pairs = similar_classes(_body(spark, sf))
    return pairs_of(members, pairs).select("chunk_a", "chunk_b")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels spread over edges and jump to their label's label until nothing changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))  # nodes without edges are their own
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk of enough words: its group (connected by similarity), how many classes its text is linked to, copies of its class."""
    members, pairs = similar_classes(_body(spark, sf))
    pairs = cut(pairs)
    links = pairs.select(F.col("class_a").alias("class")).union(pairs.select("class_b")).groupBy("class").agg(F.count("*").alias("links"))
    comp = components(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), members.select(F.col("class").alias("node")).distinct())
    size = members.groupBy("class").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    per = comp.select(F.col("node").alias("class"), "component").join(size, "class").join(links, "class", "left")
    head = per.groupBy("component").agg(F.min("first_id").alias("group_id"))
    per = per.join(head, "component").select("class", "group_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return members.join(per, "class").select("id", F.col("grp").alias("document_id"), "group_id", "links", "copies")


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
#: All pairs that share a shingle, counted: exact, for small tables.
SQL = {
    "p2_found": r"""WITH c AS (SELECT DISTINCT id, document_id, text FROM chunks WHERE kind = 'body' AND text IS NOT NULL), w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
      s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 25), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      i AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
      SELECT i.a AS chunk_a, i.b AS chunk_b FROM i JOIN n x ON x.id = i.a JOIN n y ON y.id = i.b JOIN c p ON p.id = i.a JOIN c q ON q.id = i.b WHERE k >= 0.6 * (x.n + y.n - k) AND p.document_id <> q.document_id AND p.text <> q.text"""
}
