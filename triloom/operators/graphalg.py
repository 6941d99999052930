"""Graph algorithms on edge tables, as joins iterated to a fixpoint; each round is cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.session import col, cut


def _mark(edges: DataFrame) -> tuple:
    """Number and fingerprint of an edge set: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of the undirected graph; a component's name is its smallest node.

    Alternates large-star and small-star steps, which take O(log² n) rounds on any graph, a path included. Hot nodes are
    pre-aggregated by the minimum. Edges with a null end are left out; a loop makes its node a component.
    """
    e = edges.select(col(edges, src).alias("u"), col(edges, dst).alias("v")).dropna()
    nodes = e.select("u").unionAll(e.select(F.col("v").alias("u"))).distinct()
    # kept as u > v: every edge points to the smaller node
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _mark(e)
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small, "small")
        mark = _mark(new)
        if mark == last:
            break
        e, last = new, mark
    return nodes.join(new, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def bfs_tree(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(root, node, parent, depth) of the undirected graph, breadth first; of several parents the smallest. ``roots``: node.

    One join for each level: neighbours of a level's nodes are in it, in the one before or in the next, so a level is compared with
    two others and not with all nodes reached. The root has no parent and depth 0.
    """
    e = edges.select(col(edges, src).alias("u"), col(edges, dst).alias("v")).dropna()
    e = cut(e.unionAll(e.select("v", "u")).where("u <> v").distinct(), "edges")
    new = cut(roots.select(F.col("node").alias("root"), "node", F.lit(None).cast(dict(e.dtypes)["u"]).alias("parent"), F.lit(0).alias("depth")).distinct(), "level")
    levels = [new]
    while not new.isEmpty():
        near = new if len(levels) < 2 else new.unionByName(levels[-2])
        met = new.select("root", F.col("node").alias("u"), (F.col("depth") + 1).alias("depth")).join(e, "u").groupBy("root", F.col("v").alias("node"), "depth").agg(F.min("u").alias("parent"))
        new = cut(met.join(near.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "parent", "depth"), "level")
        levels.append(new)
    tree = levels[0]
    for level in levels[1:-1]:  # the last is empty
        tree = tree.unionByName(level)
    return tree


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(root, node, size) of a tree from :func:`bfs_tree`: nodes below and including each one, summed from the deepest level up."""
    tree = cut(tree, "tree", by="depth")  # a level is read from its own folder
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.select("root", "node", F.lit(0).cast("long").alias("size"))
    out = None
    below = None
    for d in range(deepest, -1, -1):
        level = tree.where(F.col("depth") == d).select("root", "node", "parent")
        if below is None:
            size = level.withColumn("size", F.lit(1).cast("long"))
        else:
            size = level.join(below, ["root", "node"], "left").select("root", "node", "parent", (F.coalesce("more", F.lit(0)) + 1).alias("size"))
        size = cut(size, "sizes")
        below = size.groupBy("root", F.col("parent").alias("node")).agg(F.sum("size").alias("more"))
        out = size if out is None else out.unionByName(size)
    return out.select("root", "node", "size")
