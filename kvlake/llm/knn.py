"""Exact top-k by inner product: a dual-tree search over cover trees.

Rows are packed where they lie into blocks of bounded size, each with a cover tree; queries likewise.
A pair of nodes (group of queries, group of rows) is bounded by the centres' product and both covering radii, and by
their longest vectors, and pruned once that bound is below the worst kth score of the group of queries. Of a pair of leaves
the queries go on that the leaf's ball may still serve, and what is left is one small matrix product.

Query blocks form groups that a task can hold, and data blocks are dealt to lanes. A task takes one group and one lane:
it holds the group's trees with their kth scores, while the lane's blocks stream through. So a data block is sent
once for each group of queries, GROUP_BLOCKS blocks of them, and no row carries a block of either side for a block of the other.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block, queries in a block, and points in a leaf.
BLOCK_ROWS, BLOCK_QUERIES, LEAF = 8192, 1024, 128
#: Children of a node at most; blocks of queries that a task holds.
FAN, GROUP_BLOCKS = 16, 32


class CoverTree:
    """Points ordered so that each node is a slice; a node's centre is one of its points, all within its radius.

    A node of scale s splits at s/2 into children whose centres are more than s/2 apart and whose points are
    within s/2 of them; the node's own centre is a child's centre again. Where that takes more than FAN
    children, as in many dimensions, the points left over join their nearest centre, and its radius grows to
    cover them. Nodes of LEAF points, or of equal points, are leaves.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.arange(n)
        self.lo, self.hi, self.radius, self.kids, centre = [], [], [], [], []
        norms = (points * points).sum(axis=1)

        def away(c: int, idx: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norms[idx] - 2 * (points[idx] @ points[c]) + norms[c], 0))

        def add(lo: int, hi: int, c: int, dist: np.ndarray) -> int:
            self.lo.append(lo), self.hi.append(hi), centre.append(c), self.kids.append([])
            self.radius.append(float(dist.max(initial=0)))
            return len(self.lo) - 1

        todo = [(add(0, n, 0, d := away(0, self.order)), d)] if n else []
        while todo:
            k, dist = todo.pop()
            lo, hi, scale = self.lo[k], self.hi[k], self.radius[k] / 2
            if hi - lo <= LEAF or self.radius[k] <= 1e-9:
                continue
            idx, rest, groups = self.order[lo:hi], np.arange(hi - lo), []
            c, d = centre[k], dist
            while len(rest):
                near = d <= scale
                groups.append((c, rest[near], d[near]))
                rest = rest[~near]
                if len(groups) == FAN and len(rest):  # too many apart for this scale: each joins its nearest centre
                    every = np.stack([away(g[0], idx[rest]) for g in groups])
                    which = every.argmin(axis=0)
                    groups = [(g[0], np.append(g[1], rest[which == j]), np.append(g[2], every[j, which == j])) for j, g in enumerate(groups)]
                    break
                if len(rest):
                    c = idx[rest[int(np.argmax(d[~near]))]]
                    d = away(c, idx[rest])
                    d[idx[rest] == c] = 0.0
            self.order[lo:hi] = idx[np.concatenate([g for _, g, _ in groups])]
            at = lo
            for c, g, d in groups:
                self.kids[k].append(kid := add(at, at + len(g), c, d))
                todo.append((kid, d))
                at += len(g)
        self.points = points[self.order]
        norms = np.sqrt(norms[self.order])
        self.longest = np.array([norms[a:b].max(initial=0) for a, b in zip(self.lo, self.hi)])
        self.centres = points[centre] if n else points[:0]
        self.lengths = np.sqrt((self.centres * self.centres).sum(axis=1))
        self.radii = np.array(self.radius)
        self.lo, self.hi = np.array(self.lo, int), np.array(self.hi, int)
        self.kids = [np.array(x, int) for x in self.kids]


class Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def take(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        hit = np.flatnonzero((score >= self.score[of, -1:]).any(axis=1))
        if not len(hit):
            return
        s = np.concatenate((self.score[of[hit]], score[hit]), axis=1)
        i = np.concatenate((self.id[of[hit]], np.broadcast_to(ids, (len(hit), len(ids)))), axis=1)
        top = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[of[hit]], self.id[of[hit]] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def search(q: CoverTree, q_ids: np.ndarray, x: CoverTree, x_ids: np.ndarray, best: Best) -> int:
    """Bring best up to date with the rows of x; the number of products of one query and one row that were computed."""

    def loose(up: np.ndarray) -> np.ndarray:
        return up + 1e-9 * np.abs(up) + 1e-6  # rounding must not prune a tie

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, rb = q.radii[a][:, None], x.radii[b][None, :]
        up = q.centres[a] @ x.centres[b].T + ra * x.lengths[b][None, :] + rb * q.lengths[a][:, None] + ra * rb
        return loose(np.minimum(up, q.longest[a][:, None] * x.longest[b][None, :]))

    if not len(q.points) or not len(x.points):
        return 0
    size = np.sqrt((q.points * q.points).sum(axis=1))
    done, tick = 0, 0
    zero = np.zeros(1, int)
    todo = [(-float(bounds(zero, zero)[0, 0]), 0, 0, 0)]
    while todo:  # the pair that promises most comes first, so kth scores rise early
        bound, _, a, b = heapq.heappop(todo)
        if -bound < best.score[q.lo[a] : q.hi[a], -1].min():
            continue
        ka, kb = q.kids[a], x.kids[b]
        if not len(ka) and not len(kb):
            lo, rows = q.lo[a], slice(x.lo[b], x.hi[b])
            near = loose(q.points[lo : q.hi[a]] @ x.centres[b] + size[lo : q.hi[a]] * x.radii[b])
            ask = lo + np.flatnonzero(near >= best.score[lo : q.hi[a], -1])
            done += len(ask) * (rows.stop - rows.start)
            s = q.points[ask] @ x.points[rows].T
            s[q_ids[ask, None] == x_ids[None, rows]] = -np.inf
            best.take(ask, s, x_ids[rows])
            continue
        if len(kb) and (not len(ka) or x.radii[b] >= q.radii[a]):
            ka = np.array([a])
        else:
            kb = np.array([b])
        up = bounds(ka, kb)
        worst = np.array([best.score[q.lo[i] : q.hi[i], -1].min() for i in ka])
        for i, j in zip(*np.nonzero(up >= worst[:, None]), strict=True):
            tick += 1
            heapq.heappush(todo, (-float(up[i, j]), tick, int(ka[i]), int(kb[j])))
    return done


def _packed(rows: int, k: int | None, lanes: int):
    """Blocks of (id, vector) rows as (dim, lane, key, block); of equal vectors in a data block only the k rows of smallest ids can matter, besides those of any one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([i for i, _ in held[dim]])
            v = np.concatenate([v for _, v in held[dim]])
            held[dim] = []
            by = np.argsort(ids, kind="stable")
            ids, v = ids[by], v[by]
            if k is not None:
                _, which = np.unique(v, axis=0, return_inverse=True)
                which = which.ravel()
                by = np.argsort(which, kind="stable")
                first = np.concatenate(([0], np.flatnonzero(np.diff(which[by])) + 1))
                place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
                run = np.concatenate(([0], np.flatnonzero(np.diff(which[by]) | np.diff(ids[by])) + 1))  # rows of one id and vector
                many, base = np.diff(np.append(run, len(by))), which[by][run] * (len(by) + 1)
                most = np.maximum.accumulate(base + many) - base
                own = np.where(place[run] == 0, 0, np.append(0, most[:-1]))  # rows before these that one query may not count
                by = np.sort(by[place - np.repeat(own, many) < k])
                ids, v = ids[by], v[by]
            tree = CoverTree(v)
            if np.array_equal(tree.points, tree.points.astype(np.float32)):
                tree.points = tree.points.astype(np.float32)  # for the way; products are of doubles
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dim]), pa.array([(part + 7919 * (made - 1)) % lanes]), pa.array([part * 1_000_000 + made]), pa.array([pickle.dumps((ids[tree.order], tree), 5)], pa.binary())],
                ["dim", "lane", "key", "block"],
            )

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            at = np.concatenate(([0], np.cumsum(size)))
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                for cut in range(0, len(mine), rows):
                    some = mine[cut : cut + rows]
                    held.setdefault(int(dim), []).append((ids[some], flat[at[some][:, None] + np.arange(dim)].reshape(len(some), dim)))
                    if sum(len(i) for i, _ in held[int(dim)]) >= rows:
                        yield pack(int(dim))
        for dim in sorted(held):
            if held[dim]:
                yield pack(dim)

    return run


_LONG = (1 << 63) - 1


def _answers(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for ids, _, best in held:
                got = np.isfinite(best.score)
                clipped = [max(-_LONG, min(_LONG, int(s))) for s in best.score[got]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[got.ravel()]), pa.array(best.id[got]), pa.array(clipped, pa.int64())], ["query_id", "vec_id", "score"])

        for b in batches:
            for cell, side, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if cell != now:
                    yield from told()
                    now, held = cell, []
                ids, tree = pickle.loads(block.as_py())
                tree.points = tree.points.astype(np.float64)
                if side == 0:
                    held.append((ids, tree, Best(len(ids), k)))
                else:
                    for q_ids, q, best in held:
                        search(q, q_ids, tree, ids, best)
        yield from told()

    return run


def top_k(queries: DataFrame, data: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of highest inner product, all if fewer.

    queries and data: vec_id long and v, an array of whole numbers as doubles. Rows with a null id or vector take no
    part; rows with the query's own id are not its candidates; a query id that occurs twice asks once, with its
    smallest vector; rows that repeat an id count once each. Only vectors of one length are compared. Ties go to
    the smaller vec_id. Scores are exact while products stay below 2 ** 53, and are kept within the range of a
    long. No queries or no data: no rows.
    """
    spark = data.sparkSession
    data = data.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select("vec_id", "v").filter("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = data.count(), asked.count()
    groups = max(1, -(-m // (block_queries * GROUP_BLOCKS)))
    lanes = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows)))
    kind = "dim long, lane long, key long, block binary"
    x = data.mapInArrow(_packed(block_rows, k, lanes), kind)
    q = asked.coalesce(max(1, min(lanes * groups, m // block_queries))).sortWithinPartitions("vec_id").mapInArrow(_packed(block_queries, None, groups), kind)
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    q = q.select("dim", F.col("lane").alias("group"), every(lanes).alias("lane"), F.lit(0).alias("side"), "key", "block")
    x = x.select("dim", every(groups).alias("group"), "lane", F.lit(1).alias("side"), "key", "block")
    met = q.union(x).select(F.concat_ws("/", "dim", "group", "lane").alias("cell"), "side", "key", "block")
    met = met.repartition("cell").sortWithinPartitions("cell", "side", "key").select("cell", "side", "block")
    found = met.mapInArrow(_answers(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * component) of each vector; null vectors and those with a null or non-finite component are left out."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
