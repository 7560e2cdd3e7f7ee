"""Most similar vectors for every vector: a hierarchical k-means tree, searched best bin first.

For each model a tree is fitted in two levels whose number of leaves follows the number of vectors. The upper
level comes from a bounded sample (SAMPLE vectors, chosen by hash); inside each of its cells a subtree is
fitted by the executors, down to leaves of LEAF vectors, or larger ones once the centroids of all leaves would
take more than TREE_BYTES. Every vector is put into the leaf it descends to. A query keeps a priority queue of nodes by
distance to their centroids: the nearest is taken, an inner node queues its children, a leaf is visited.
A pair is looked at if either of its vectors visits the leaf of the other, and counts for both. How
many leaves a query visits is calibrated on vectors outside of the sample: they are answered by brute force over all rows,
and the number is the least at which TARGET of those pairs are looked at.

Leaves are grouped, in the order of the tree, into blocks of bounded size. A vector is sent once to the
block of its leaf as a row, and as a query to the other blocks that it visits, where queries stream past the rows.

Usable vectors are not null, have ``dim`` finite values and are not all zero; each chunk id counts once.
Equal vectors form a class: one row of the class is indexed and asked, and its smallest k + 1 ids answer for
it, so copies cost nothing, however many. Ties go to the smaller id. A model of fewer than k + 1 vectors
gives what there is; no usable vectors, no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import cut, ship, table

TOP, SAMPLE, LEAF, BRANCH, TARGET, CALIBRATE, BLOCK_ROWS, TREE_BYTES, SEED = 5, 20_000, 64, 16, 0.93, 400, 65_536, 16 << 20, 11


def usable(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dim")) & (F.col("dim") > 0)
    good &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col("model").isNotNull() & good).select(key, "model", "vector")


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small ones from over- and underflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Tree:
    """Nodes in depth-first order: centroid, parent (-1 for the root), children (none for leaves), number of the leaf."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = SEED) -> None:
        self.children: list[list[int]] = []
        self.centroids: list[np.ndarray] = []
        self.counts: list[float] = []
        self._rng = np.random.default_rng(seed)
        self._grow(x, branch, leaf, 0)
        del self._rng
        self._index()

    def _index(self) -> None:
        n = len(self.children)
        self.c = np.stack(self.centroids)
        self.c2 = (self.c**2).sum(axis=1)
        self.parent = np.full(n, -1)
        depth = np.zeros(n, np.int64)
        for i, kids in enumerate(self.children):
            self.parent[kids] = i
        for i in range(1, n):  # parents come before their children
            depth[i] = depth[self.parent[i]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.ends = np.array([i for i, kids in enumerate(self.children) if not kids])
        self.leaf = np.full(n, -1)
        self.leaf[self.ends] = np.arange(len(self.ends))
        self.leaves = len(self.ends)

    def _grow(self, x: np.ndarray, branch: int, leaf: int, depth: int) -> int:
        me = len(self.children)
        self.children.append([])
        self.centroids.append(x.mean(axis=0))
        self.counts.append(float(len(x)))
        parts = self._split(x, min(branch, max(2, len(x) // leaf))) if len(x) > 1.5 * leaf and depth < 12 else []
        if len(parts) > 1:
            self.children[me] = [self._grow(p, branch, leaf, depth + 1) for p in parts]
        return me

    def _split(self, x: np.ndarray, k: int, rounds: int = 8) -> list[np.ndarray]:
        c = x[self._rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            at = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
            c = np.stack([x[at == i].mean(axis=0) if (at == i).any() else x[self._rng.integers(len(x))] for i in range(k)])
        at = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        return [x[at == i] for i in range(k) if (at == i).any()]

    def grafted(self, below: dict[int, Tree], scale: float) -> Tree:
        """A tree whose leaves (by number) have grown into the given subtrees; counts of subtrees are scaled, those of other leaves come from them too."""
        out = Tree.__new__(Tree)
        out.children, out.centroids, out.counts = [], [], []

        def copy(tree: Tree, node: int, times: float) -> int:
            if tree is self and not tree.children[node] and int(self.leaf[node]) in below:
                return copy(below[int(self.leaf[node])], 0, scale)
            me = len(out.children)
            out.children.append([])
            out.centroids.append(tree.c[node])
            out.counts.append(tree.counts[node] * times)
            out.children[me] = [copy(tree, k, times) for k in tree.children[node]]
            return me

        copy(self, 0, 1.0)
        out._index()
        return out

    def sizes(self) -> np.ndarray:
        """Vectors of each leaf when it was fitted."""
        return np.array(self.counts)[self.ends]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector descends to."""
        out = np.full(len(x), -1, np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = np.argmin(self.c2[kids] - 2 * x[rows] @ self.c[kids].T, axis=1)
            todo += [(k, rows[near == i]) for i, k in enumerate(kids)]
        return out

    def keys(self, x: np.ndarray) -> np.ndarray:
        """When each leaf leaves each query's priority queue, as a number to sort by. A queue hands out a node once its parent is
        out and nothing nearer waits, so of two leaves the one comes first whose farthest node below their common ancestor
        is nearer: they sort by the farthest node of the whole path, then of the path from the second level on, and so
        forth. The keys of four levels are added with weights of 1, 1e-4, ...: nodes whose distances differ by less may swap."""
        d = self.c2[:, None] - 2 * self.c @ x.T
        out = np.zeros((self.leaves, len(x)))
        far = np.empty_like(d)
        for start in range(min(4, len(self.levels))):
            far[:] = -9.0
            far[self.levels[start]] = d[self.levels[start]]
            for nodes in self.levels[start + 1 :]:
                far[nodes] = np.maximum(far[self.parent[nodes]], d[nodes])
            out += 1e-4**start * far[self.ends]
        return np.ascontiguousarray(out.T)

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n leaves of each query, best bin first."""
        step = max(16, 2_000_000 // len(self.children))
        return np.concatenate([np.argsort(self.keys(x[i : i + step]), axis=1, kind="stable")[:, :n] for i in range(0, len(x), step)]) if len(x) else np.zeros((0, n), np.int64)

    def seen(self, x: np.ndarray, n: int) -> np.ndarray:
        """For each query and leaf: whether it is among the first n."""
        out = np.zeros((len(x), self.leaves), bool)
        if n >= self.leaves:
            return ~out
        step = max(16, 2_000_000 // len(self.children))
        for i in range(0, len(x), step):
            np.put_along_axis(out[i : i + step], np.argpartition(self.keys(x[i : i + step]), n - 1, axis=1)[:, :n], True, axis=1)
        return out


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    return part


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of lists of one length."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(c), -1) if len(c) else np.zeros((0, 1), np.float32)


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    return pa.Array.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x, np.float32))]).cast(pa.binary())


def _rows(column: pa.ChunkedArray, dtype: str = "<f4") -> np.ndarray:
    """The other way round."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class _Best:
    """The k best (similarity, id) found so far of each of n vectors; ties go to the smaller id. Hits are put in their places many at once."""

    def __init__(self, n: int, k: int) -> None:
        self.s, self.r, self.k = np.full((n, k), -2, np.float32), np.full((n, k), -1, np.int64), k
        self.wait: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def look(self, q: np.ndarray, sims: np.ndarray, ids: np.ndarray, down: bool = False) -> None:
        """Similarities of the vectors q, which are the rows of ``sims`` (or, ``down``, its columns), to ``ids``."""
        axis = 0 if down else 1
        least = self.s[q, -1]
        if sims.shape[axis] > self.k and (least == -2).any():  # nothing below the k-th of these can stay
            part = np.partition(sims, -self.k, axis=axis)
            least = np.maximum(least, part[-self.k] if down else part[:, -self.k])
        hits = np.flatnonzero(sims >= (least[None, :] if down else least[:, None]))
        r, c = np.divmod(hits, sims.shape[1])
        v = sims.ravel()[hits]
        if down:
            r, c = c, r
        self.wait.append((q[r], v, ids[c]))
        self.waiting += len(v)
        if self.waiting > 100_000:
            self.settle()

    def settle(self) -> _Best:
        if self.waiting:
            row, v, other = map(np.concatenate, zip(*self.wait))
            order = np.lexsort((-v, row))
            order = order[v[order] > -2]
            row, v, other = row[order], v[order], other[order]
            start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            end = np.append(start[1:], len(row))
            place, shift = np.arange(self.k), np.maximum(np.arange(self.k) - 1, 0)
            while len(start):  # the next hit of each vector goes to its place among the k best, until one is worse than these
                at, new_s, new_r = row[start], v[start][:, None], other[start][:, None]
                old_s, old_r = self.s[at], self.r[at]
                pos = ((old_s > new_s) | ((old_s == new_s) & (old_r < new_r))).sum(axis=1)[:, None]
                self.s[at] = np.where(place < pos, old_s, np.where(place == pos, new_s, old_s[:, shift]))
                self.r[at] = np.where(place < pos, old_r, np.where(place == pos, new_r, old_r[:, shift]))
                on = (new_s[:, 0] >= old_s[:, -1]) & (start + 1 < end)
                start, end = start[on] + 1, end[on]
        self.wait, self.waiting = [], 0
        return self


def _calibrate(reps: DataFrame, tree: Tree, queries: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
    """Leaf visits at which the share ``target`` of the exact answers of the queries is seen, from either side."""

    def exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                own, x = b.column(0).to_numpy(), _matrix(b.column(1))
                sims = queries @ x.T
                sims[ids[:, None] == own[None, :]] = -2
                at = _top(sims, k)
                q = np.repeat(np.arange(len(ids), dtype=np.int32), at.shape[1])
                at = at.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own[at]), pa.array(sims[q, at].astype(float)), _bytes(x).take(pa.array(at))], names=["q", "rep", "sim", "vec"])

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "rep")
    best = reps.mapInArrow(exact, "q int, rep bigint, sim double, vec binary").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).where("sim > -2").select("q", "vec").toPandas()  # at most CALIBRATE * k rows
    if not len(best):
        return 1
    q, other = best["q"].to_numpy(), np.frombuffer(b"".join(best["vec"]), "<f4").reshape(len(best), -1)

    def rank(x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.concatenate([(lambda key, at: (key < np.take_along_axis(key, at[:, None], axis=1)).sum(axis=1))(tree.keys(x[i : i + 64]), leaf[i : i + 64]) for i in range(0, len(x), 64)])

    seen = np.sort(np.minimum(rank(queries[q], tree.assign(other)), rank(other, tree.assign(queries)[q])))
    return int(seen[min(len(seen) - 1, int(np.ceil(target * len(seen))) - 1)]) + 1


def _picked(reps: DataFrame, n: int, rows: int, seed: int) -> DataFrame:
    """About ``rows`` of n rows by hash, all of them if there are no more."""
    share = min(1.0, 1.2 * rows / n)
    return reps if share == 1.0 else reps.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))


def fit(reps: DataFrame, n: int, dim: int, sample: int = SAMPLE, leaf: int = LEAF, tree_bytes: int = TREE_BYTES) -> tuple[Tree, np.ndarray]:
    """(tree, sampled ids) of the classes (rep, vector) of one model."""
    got = _picked(reps, n, sample, SEED).orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(sample).toPandas()  # a bounded sample
    x, ids = np.stack(got["vector"].to_numpy()).astype(np.float32), got["rep"].to_numpy()
    top = Tree(x, leaf=leaf)
    if n <= len(x):
        return top, ids
    leaves = min(n / leaf, tree_bytes / (4 * dim))
    rows = min(n, int(leaf * leaves))  # fitted on as many rows as a leaf holds for each leaf
    sent = reps.sparkSession.sparkContext.broadcast(top)  # no more centroids than the sample has leaves

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.assign(x)), b.column(0), _bytes(x)], names=["cell", "rep", "vec"])

    def grow(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by("rep")  # the same tree whatever the order of arrival
        t = Tree(_rows(tbl.column("vec")), leaf=leaf)
        return pa.table({"cell": tbl.column("cell").slice(0, 1), "tree": pa.array([pickle.dumps(t)], pa.binary())})

    grown = _picked(reps, n, rows, SEED + 1).mapInArrow(cells, "cell bigint, rep bigint, vec binary").groupBy("cell").applyInArrow(grow, "cell bigint, tree binary").collect()  # tree_bytes of centroids in all
    return top.grafted({r[0]: pickle.loads(r[1]) for r in grown}, n / rows), ids


def blocks_of(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, last leaf of each block; first block, number of blocks of each leaf): leaves in the order of the tree, a leaf of more than
    two blocks' size in blocks of its own."""
    first, last, block, parts = [], [], np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    room = 0.0
    for i, s in enumerate(sizes):
        cut = int(-(-s // rows)) if s > 2 * rows else 1
        if cut > 1 or room < s or not first:
            block[i], parts[i] = len(first), cut
            first += [i] * cut
            last += [i] * cut
            room = 0.0 if cut > 1 else rows - s
        else:
            block[i] = len(first) - 1
            last[-1] = i
            room -= s
    return np.array(first), np.array(last), block, parts


class _Block:
    """The rows of one block, and the k best found so far for each."""

    def __init__(self, rep: np.ndarray, leaf: np.ndarray, x: np.ndarray, lo: int, k: int) -> None:
        order = np.argsort(leaf, kind="stable")
        self.order, self.rep, self.x, self.k = order, rep[order], x[order], k
        self.leaf = leaf[order] - lo
        self.best = _Best(len(rep), k)

    def ask(self, rep: np.ndarray, x: np.ndarray, mask: np.ndarray, own: bool = False) -> _Best:
        """Queries against the leaves of their masks; the k best of each. What is found counts for the rows as well. ``own``: the queries are the rows themselves."""
        best = _Best(len(rep), self.k)
        for at in range(mask.shape[1]):
            a, b = np.searchsorted(self.leaf, [at, at + 1])
            who = np.flatnonzero(mask[:, at])
            for s in range(0, len(who), 4096):
                q = who[s : s + 4096]
                for t in range(a, b, 2048):
                    u = min(b, t + 2048)
                    sims = x[q] @ self.x[t:u].T
                    if own:
                        here = np.flatnonzero((q >= t) & (q < u))
                        sims[here, q[here] - t] = -2
                    best.look(q, sims, self.rep[t:u])
                    self.best.look(np.arange(t, u), sims, rep[q], down=True)
        return best.settle()


def _found(rep: np.ndarray, best: _Best) -> pa.RecordBatch:
    """rep, the ids of its k best (-1 where there are fewer) and their similarities, packed."""
    best.settle()
    n, k = best.s.shape
    pack = lambda x, size: pa.Array.from_buffers(pa.binary(size * k), n, [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(rep), pack(best.r, 8), pack(best.s, 4)], names=["rep", "near", "sims"])


def _merge(k: int):
    """The k best of each vector out of its partial answers; what was seen from both sides counts once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            parts = np.diff(b.column(1).offsets.to_numpy()) * k
            near, sims = (np.frombuffer(b"".join(c.flatten().to_pylist()), t) for c, t in ((b.column(1), "<i8"), (b.column(2), "<f4")))
            row = np.repeat(np.arange(b.num_rows), parts)
            row, near, sims = row[near >= 0], near[near >= 0], sims[near >= 0]
            order = np.lexsort((-sims, near, row))
            row, near, sims = row[order], near[order], sims[order]
            once = np.append(True, (row[1:] != row[:-1]) | (near[1:] != near[:-1]))[: len(row)]
            row, near, sims = row[once], near[once], sims[once]
            order = np.lexsort((near, -sims, row))
            row, near, sims = row[order], near[order], sims[order]
            start = np.searchsorted(row, np.arange(b.num_rows))
            best = np.arange(len(row)) - start[row] < k
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[best])), pa.array(-sims[best].astype(float)), pa.array(near[best])], names=["rep", "d", "other"])

    return run


def _search_model(reps: DataFrame, k: int, n: int, dim: int, target: float) -> DataFrame:
    """rep, d (the cosine, negative), other: at most k for each class of one model."""
    tree, fitted = fit(reps, n, dim)
    held = _picked(reps, n, 4 * CALIBRATE, SEED + 2)
    if n > len(fitted):  # else every vector is in the sample
        known = reps.sparkSession.createDataFrame(pd.DataFrame({"rep": fitted}))
        held = held.join(F.broadcast(known), "rep", "left_anti")  # ids of a bounded sample
    asked = held.orderBy(F.xxhash64("rep", F.lit(SEED + 2)), "rep").limit(CALIBRATE).toPandas()
    visits = _calibrate(reps, tree, np.stack(asked["vector"].to_numpy()).astype(np.float32), asked["rep"].to_numpy(), k, target)
    lo, hi, block, parts = blocks_of(tree.sizes(), min(BLOCK_ROWS, max(2048, n // 8)))
    sent = reps.sparkSession.sparkContext.broadcast(tree)  # TREE_BYTES
    names = ["block", "asks", "rep", "leaf", "mask", "vec"]

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        for batch in it:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                rep, x = part.column(0).to_numpy(), _matrix(part.column(1))
                raw, leaf, seen = _bytes(x), tree.assign(x), tree.seen(x, visits)
                home = block[leaf] + ((rep * np.int64(0x9E3779B1) >> 7) & 0xFFFFFF) % parts[leaf]
                for bl in range(len(lo)):
                    here = seen[:, lo[bl] : hi[bl] + 1]
                    own = home == bl
                    mine = np.flatnonzero(here.any(axis=1) | own)
                    if len(mine):
                        bits = np.packbits(here[mine], axis=1)
                        mask = pa.array([m.tobytes() for m in bits], pa.binary())
                        full = pa.array(np.full(len(mine), bl, np.int32))
                        yield pa.RecordBatch.from_arrays([full, pa.array((~own[mine]).astype(np.int32)), pa.array(rep[mine]), pa.array(leaf[mine]), mask, raw.take(pa.array(mine))], names=names)

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = -1, [], None

        def opened(bl: int, rows: list[pa.RecordBatch]) -> tuple[_Block | None, list[pa.RecordBatch]]:
            if not rows:
                return None, []
            t = pa.Table.from_batches(rows)
            one = _Block(t.column("rep").to_numpy(), t.column("leaf").to_numpy(), _rows(t.column("vec")), int(lo[bl]), k)
            mask = bits(t.column("mask"), bl)[one.order]
            return one, [_found(one.rep, one.ask(one.rep, one.x, mask, own=True))]

        def bits(column: pa.ChunkedArray | pa.Array, bl: int) -> np.ndarray:
            return np.unpackbits(_rows(column, "u1"), axis=1)[:, : hi[bl] + 1 - lo[bl]].astype(bool)

        for batch in it:
            if not batch.num_rows:
                continue
            tag = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tag)) + 1).tolist(), len(tag)]
            for a, b in zip(edges, edges[1:]):
                bl, asks = divmod(int(tag[a]), 2)
                if bl != at:
                    if rows:  # a block that nothing else visits
                        block, out = opened(at, rows)
                        yield from out
                    if block is not None:
                        yield _found(block.rep, block.best)
                    at, rows, block = bl, [], None
                part = batch.slice(a, b - a)
                if not asks:
                    rows.append(part)
                    continue
                if rows:
                    block, out = opened(at, rows)
                    rows = []
                    yield from out
                if block is not None:  # else no row descended into this block
                    rep = part.column(2).to_numpy()
                    yield _found(rep, block.ask(rep, _rows(part.column(5)), bits(part.column(4), bl)))
        if rows:
            block, out = opened(at, rows)
            yield from out
        if block is not None:
            yield _found(block.rep, block.best)

    routed = reps.mapInArrow(route, "block int, asks int, rep bigint, leaf bigint, mask binary, vec binary")
    found = routed.repartitionById(len(lo), "block").sortWithinPartitions("block", "asks").mapInArrow(answer, "rep bigint, near binary, sims binary")
    # no more partial answers to a vector than blocks it visits and one for its own
    return found.groupBy("rep").agg(F.collect_list("near").alias("near"), F.collect_list("sims").alias("sims")).mapInArrow(_merge(k), "rep bigint, d double, other bigint")


def neighbours(df: DataFrame, key: str = "chunk_id", k: int = TOP, target: float = TARGET) -> DataFrame:
    """key, model, rank (1..k), neighbour, cosine: the k most similar other vectors of the same model."""
    ship(df.sparkSession)
    x = usable(df, key).withColumn("h1", F.xxhash64("model", "vector")).withColumn("h2", F.xxhash64(F.lit(3), "vector", "model"))
    member = cut(x.groupBy(key).agg(F.min(F.struct("h1", "h2", "model")).alias("m")).select(key, "m.*"))
    first = member.withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(key))).where(F.col("rn") <= k + 1)
    classes = cut(first.groupBy("h1", "h2").agg(F.min(key).alias("rep"), F.sort_array(F.collect_list(key)).alias("members"), F.min("model").alias("model")))

    def normalise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lengths = pc.list_value_length(batch.column(2)).to_numpy()
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                x = unit(_matrix(part.column(2)))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * int(size))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["rep", "model", "vector"])

    chosen = classes.select(F.col("rep").alias(key), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    one = x.join(chosen, key).where("h1 = g1 AND h2 = g2").dropDuplicates([key])
    reps = cut(one.select(F.col(key).alias("rep"), "model", "vector").mapInArrow(normalise, "rep bigint, model string, vector array<float>"))
    sizes = reps.groupBy("model", F.size("vector").alias("dim")).count().collect()  # one row for each model and length
    found = None
    for model, dim, n in sorted(map(tuple, sizes)):
        of = reps.where((F.col("model") == model) & (F.size("vector") == dim)).select("rep", "vector")
        part = _search_model(of, k, n, dim, target)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return df.sparkSession.createDataFrame([], f"`{key}` bigint, model string, rank int, neighbour bigint, cosine double")
    of = classes.select("rep", "members")
    wide = found.join(of.select(F.col("rep").alias("other"), "members"), "other").groupBy("rep").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(F.col("d"), m.alias("id"))))).alias("c"))
    whole = of.join(wide, "rep", "left").select("rep", F.array_sort(F.concat(F.transform("members", lambda m: F.struct(F.lit(-1.0).alias("d"), m.alias("id"))), F.coalesce("c", F.array().cast("array<struct<d:double,id:bigint>>")))).alias("c"))
    near = member.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).join(whole, "rep")
    near = near.select(key, "model", F.posexplode(F.slice(F.filter("c", lambda s: s["id"] != F.col(key)), 1, k)).alias("rank", "s"))
    return near.select(key, "model", (F.col("rank") + 1).alias("rank"), F.col("s.id").alias("neighbour"), (-F.col("s.d")).alias("cosine"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours(table(spark, sf, "chunk_vectors")).where("cosine >= 0.8")
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(table(spark, sf, "chunk_vectors"))


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
#: Brute force; the search equals it while it visits all that matters, as in the smaller test tables.
SQL = {
    "p5_found": """WITH u AS (SELECT DISTINCT ON (chunk_id) chunk_id, model, vector::DOUBLE[] AS v FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
      n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM u), s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.v, b.v) / (a.l * b.l) AS cos FROM n a JOIN n b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
      k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) <= 5) SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k WHERE cos >= 0.8"""
}
