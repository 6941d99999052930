"""Nearest neighbours of every vector: a navigable small-world graph for each shard, shard results merged.

Shards are the leaves of a tree that halves a bounded sample along the line between two centres, so all are about equal
in size however the vectors lie. Every vector is indexed in its own leaf and searched in the leaves whose half-spaces it
violates least. What lies behind no half-space farther than the k-th distance found so is then scanned too, so no leaf that
may hold a nearer vector is left out. Equal vectors are indexed once; of each, the few records with the smallest names stand for all, since no
other can be among the nearest of any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.llm.hnsw import Hnsw
from triloom.session import arrow, col, cut

#: Vectors the tree is fitted on, at most (on the driver), and for up to 4,096 leaves.
SAMPLE, FEW = 262_144, 65_536
#: Sampled vectors that a leaf holds, at least: so there are at most 16,384 leaves, and a leaf grows beyond ``leaf_rows`` only with more than 134 million vectors.
LEAF_SAMPLE = 16
#: Cells of vectors and leaves that are looked at together.
CELLS = 8_000_000


class Tree:
    """Balanced halving; node i of a level has children 2i and 2i + 1."""

    def __init__(self, x: np.ndarray, depth: int, seed: int = 1):
        self.depth = depth
        self.normals: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        rng = np.random.default_rng(seed)
        groups = [x.astype(np.float32)]
        for _ in range(depth):
            normals, offsets, halves = [], [], []
            for g in groups:
                w = self._axis(g, rng)
                p = g @ w
                at = np.argsort(p, kind="stable")
                half = len(at) // 2
                offsets.append((p[at[half - 1]] + p[at[half]]) / 2 if half else 0.0)
                normals.append(w)
                halves += [g[at[:half]], g[at[half:]]]
            self.normals.append(np.array(normals, np.float32))
            self.offsets.append(np.array(offsets, np.float32))
            groups = halves

    @staticmethod
    def _axis(g: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Unit vector between the centres of two clusters, a few rounds of Lloyd's method."""
        if len(g) < 2:
            return np.eye(1, g.shape[1], dtype=np.float32)[0]
        c = g[rng.choice(len(g), 2, replace=False)].astype(np.float64)
        for _ in range(8):
            near = ((g - c[0]) ** 2).sum(1) < ((g - c[1]) ** 2).sum(1)
            if near.all() or not near.any():
                break
            c = np.array([g[near].mean(0), g[~near].mean(0)])
        w = c[1] - c[0]
        size = np.sqrt((w**2).sum())
        return (w / size if size else np.eye(1, g.shape[1])[0]).astype(np.float32)

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` leaves of each vector with the least squared violations, its own leaf first."""
        cost = np.zeros((len(x), 1), np.float32)
        for w, b in zip(self.normals, self.offsets):
            side = x @ w.T - b
            off = np.empty((len(x), 2 * side.shape[1]), np.float32)
            off[:, 0::2] = cost + np.where(side >= 0, side**2, 0)
            off[:, 1::2] = cost + np.where(side < 0, side**2, 0)
            cost = off
        k = min(probes, cost.shape[1])
        best = np.argpartition(cost, k - 1, axis=1)[:, :k]
        return np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)

    def lowest(self, x: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """For each vector and leaf a bound below every squared distance to the leaf's vectors: the largest violation less ``slack``, squared.

        Violations of several half-spaces don't add up, since their normals need not be at right angles.
        """
        far = np.zeros((len(x), 1))
        for w, b in zip(self.normals, self.offsets):
            side = x @ w.T.astype(np.float64) - b
            off = np.empty((len(x), 2 * side.shape[1]))
            off[:, 0::2] = np.maximum(far, side)
            off[:, 1::2] = np.maximum(far, -side)
            far = off
        return np.maximum(0, far - slack[:, None]) ** 2


def _packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes, in the fewest bytes a number that hold each vector."""
    kinds = [np.dtype(t) for t in ("<i2", "<i4", "<i8")]
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = sum(((low < np.iinfo(k).min) | (high > np.iinfo(k).max)).astype(np.int64) for k in kinds[:2])
    small = [x.astype(k) for k in kinds]
    return pa.array([small[w][i].tobytes() for i, w in enumerate(width)], pa.binary())


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    size = np.array([len(v) for v in raw], np.int64)
    out = np.empty((len(raw), dim), np.int64)
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{width // dim}").reshape(-1, dim)
    return out


def _route(tree: Tree, dim: int, probes: int):
    """Each vector as a row of its leaf (index), where it is a query too, and as a query of the other leaves it may have neighbours in."""
    step = min(2000, max(1, CELLS >> (tree.depth + 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
                leaves = tree.leaves(x.astype(np.float32), probes)
                n, p = leaves.shape
                take = pa.array(np.r_[np.arange(n), np.repeat(np.arange(n), p - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[leaves[:, 0], leaves[:, 1:].ravel()].astype(np.int32)), pa.array(np.r_[np.zeros(n, bool), np.ones(n * (p - 1), bool)]), batch.column(0).take(take), _packed(x).take(take)], ["leaf", "query", "cid", "vec"])

    return run


def _nearest(dim: int, k: int, m: int, ef_build: int, ef: int):
    """Rows come sorted by leaf, index rows before queries: the leaf's graph is built, its own vectors are searched, then its queries stream through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, graph = None, None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        index, x = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)

        def searched(q: np.ndarray, qv: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(q), 2000):
                part, v = q[lo : lo + 2000], qv[lo : lo + 2000]
                at, _ = graph.search(v, k, ef)
                r, c = np.nonzero(at >= 0)
                found = at[r, c]
                gap = x[found] - v[r]
                d2 = np.einsum("ij,ij->i", gap, gap)  # exact: the graph's distances are single precision
                yield pa.RecordBatch.from_arrays([pa.array(part[r]), pa.array(index[found]), pa.array(d2)], ["cid", "nb", "d2"])

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal index, x, graph
            index = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            x = np.concatenate(rows) if rows else np.zeros((0, dim), np.int64)
            order = np.argsort(index, kind="stable")
            index, x = index[order], x[order]
            graph = Hnsw(x, m=m, ef=ef_build)
            yield from searched(index, x)

        for batch in batches:
            leaves = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if leaves[a] != leaf:
                    if ids and graph is None:
                        yield from build()
                    leaf, graph, ids, rows = leaves[a], None, [], []
                is_query = part.column(1).to_numpy(zero_copy_only=False)
                cid, v = part.column(2).to_numpy(), _numbers(part.column(3), dim)
                if not is_query.all():
                    ids.append(cid[~is_query])
                    rows.append(v[~is_query])
                if not is_query.any():
                    continue
                if graph is None:
                    yield from build()
                yield from searched(cid[is_query], v[is_query])
        if ids and graph is None:
            yield from build()

    return run


def _route_rest(tree: Tree, dim: int, probes: int):
    """Each vector as a row of its leaf, and as a query of the leaves not searched yet that may hold a vector within ``bound``."""

    step = min(2000, max(1, CELLS >> (tree.depth + 3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
                bound = np.nan_to_num(batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=np.inf)
                leaves = tree.leaves(x.astype(np.float32), probes)
                reach = np.sqrt((x.astype(np.float64) ** 2).sum(1)) + np.sqrt(bound)
                near = tree.lowest(x.astype(np.float64), 1e-4 * (1 + reach)) <= bound[:, None]
                near[~np.isfinite(bound)] = True
                np.put_along_axis(near, leaves, False, axis=1)
                who, leaf = np.nonzero(near)
                n = len(x)
                take = pa.array(np.r_[np.arange(n), who])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[leaves[:, 0], leaf].astype(np.int32)), pa.array(np.r_[np.zeros(n, bool), np.ones(len(who), bool)]), batch.column(0).take(take), _packed(x).take(take), pa.array(bound).take(take)], ["leaf", "query", "cid", "vec", "bound"])

    return run


def _scan(dim: int, k: int):
    """Rows come sorted as for :func:`_nearest`: the leaf's vectors are compared with each query, those within its bound are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, x = None, None
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for batch in batches:
            leaves = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if leaves[a] != leaf:
                    leaf, x, ids, rows = leaves[a], None, [], []
                is_query = part.column(1).to_numpy(zero_copy_only=False)
                cid, v, bound = part.column(2).to_numpy(), _numbers(part.column(3), dim), part.column(4).to_numpy()
                if not is_query.all():
                    ids.append(cid[~is_query])
                    rows.append(v[~is_query])
                if not is_query.any() or not ids:
                    continue
                if x is None:
                    index, x = np.concatenate(ids), np.concatenate(rows)
                    y = x.astype(np.float64)
                    sq = (y**2).sum(1)
                q, qv, most = cid[is_query], v[is_query], bound[is_query]
                for lo in range(0, len(q), 256):
                    p = qv[lo : lo + 256].astype(np.float64)
                    d = sq[None] + (p**2).sum(1)[:, None] - 2 * p @ y.T
                    pick = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    r, c = np.nonzero(np.take_along_axis(d, pick, 1) <= most[lo : lo + 256, None] * (1 + 1e-9))
                    found = pick[r, c]
                    gap = x[found] - qv[lo : lo + 256][r]
                    yield pa.RecordBatch.from_arrays([pa.array(q[lo : lo + 256][r]), pa.array(index[found]), pa.array(np.einsum("ij,ij->i", gap, gap))], ["cid", "nb", "d2"])

    return run


def nearest_neighbours(df: DataFrame, record: str = "fn_id", vec: str = "vec", dim: int = 79, k: int = 5, leaf_rows: int = 8192, probes: int = 4, m: int = 16, ef_build: int = 80, ef: int = 48, sample: int = SAMPLE) -> DataFrame:
    """(fn_id, neighbour, d2, rank): about the ``k`` nearest other records of each record by Euclidean distance.

    Equal distances go to the smaller name; d2 is the exact squared distance. Vectors that are null, of another length
    than ``dim``, or hold a null are left out, as are records without a name; of several vectors of a record the smallest
    counts. With fewer than k other records, all are returned; an empty table gives no rows. The tree is fitted on at most
    ``sample`` distinct vectors, chosen by hash, 16 or more for a leaf; every vector is indexed and searched, by graph in ``probes`` leaves, then by
    scan in all others that may hold a vector as near as the k-th so found. Components must be integers, their
    squared distances below 2^63.
    """
    name = col(df, record).cast("string")
    valid = df.select(name.alias("fn"), col(df, vec).cast("array<bigint>").alias("vec")).where(F.col("fn").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda v: v.isNull()))
    one = cut(valid.groupBy("fn").agg(F.min("vec").alias("vec")).select("fn", F.xxhash64("vec").alias("x1"), F.xxhash64(F.lit(1), "vec").alias("x2"), "vec"), "vectors")
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("x1", "x2").orderBy("fn"))).where(F.col("place") <= k + 1)
    first = cut(first, "first")
    distinct = cut(first.where("place = 1").select(F.monotonically_increasing_id().alias("cid"), "x1", "x2", "vec"), "distinct")
    names = distinct.select("cid", "x1", "x2")
    few = first.select("fn", "x1", "x2").join(names, ["x1", "x2"]).select("cid", "fn")
    members = one.select("fn", "x1", "x2").join(names, ["x1", "x2"]).select("cid", "fn")
    n = distinct.count()
    wanted = min(sample, max(FEW, LEAF_SAMPLE << max(0, -(-n // leaf_rows) - 1).bit_length()))
    picked = distinct.select("vec").orderBy(F.xxhash64("vec")).limit(wanted).toArrow().column(0).combine_chunks()
    rows = np.asarray(picked.flatten() if isinstance(picked, pa.Array) else pa.concat_arrays(picked.chunks).flatten()).reshape(-1, dim)
    depth = 0
    while n > leaf_rows << depth and len(rows) >= LEAF_SAMPLE << (depth + 1):
        depth += 1
    tree = Tree(rows, depth)
    routed = distinct.select("cid", "vec").transform(arrow, _route(tree, dim, probes), "leaf int, query boolean, cid long, vec binary")
    sharded = routed.repartitionById(1 << depth, "leaf").sortWithinPartitions("leaf", "query", "cid")
    per_leaf = sharded.transform(arrow, _nearest(dim, k + 4, m, ef_build, ef), "cid long, nb long, d2 long")
    top = lambda x: x.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("d2", "nb"))).where(F.col("r") <= k + 4)
    near = top(per_leaf)
    if probes < 1 << depth:
        near = cut(near, "near")
        bound = near.where(F.col("r") == k + 1).select("cid", F.col("d2").alias("bound"))  # the vector itself is among them
        rest = distinct.join(bound, "cid", "left").select("cid", "vec", "bound").transform(arrow, _route_rest(tree, dim, probes), "leaf int, query boolean, cid long, vec binary, bound double")
        more = rest.repartitionById(1 << depth, "leaf").sortWithinPartitions("leaf", "query", "cid").transform(arrow, _scan(dim, k + 4), "cid long, nb long, d2 long")
        near = top(near.drop("r").unionByName(more))
    listed = near.select("cid", "nb", "d2").join(few.select(F.col("cid").alias("nb"), "fn"), "nb")
    best = Window.partitionBy("cid").orderBy("d2", "fn")
    listed = cut(listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("cid", F.col("fn").alias("neighbour"), "d2"), "listed")
    mine = members.join(listed, "cid").where("fn <> neighbour")
    each = Window.partitionBy("fn").orderBy("d2", "neighbour")
    return mine.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k).select(F.col("fn").alias("fn_id"), "neighbour", "d2", "rank")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(fn_a, fn_b), fn_a < fn_b, of which at least one is among the neighbours of the other."""
    return neighbours.select(F.least("fn_id", "neighbour").alias("fn_a"), F.greatest("fn_id", "neighbour").alias("fn_b")).distinct()
