"""Alignment of two versions of a function graph, node by node, and the subgraphs that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Node types that are matched first, by type alone.
SKELETON = ["CFGEntryNode", "CFGExitNode", "FunctionDef"]


def degrees(nodes: DataFrame, edges: DataFrame, fn: str = "fn_id") -> DataFrame:
    """``nodes`` with in_deg and out_deg, parallel edges counted each."""
    ends = edges.select(fn, F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(fn, "dst", F.lit(1), F.lit(0)))
    per = ends.groupBy(fn, "node_id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))
    return nodes.join(per, [fn, "node_id"], "left").fillna(0, ["in_deg", "out_deg"])


def align_nodes(sig: DataFrame, nodes: DataFrame, order: str = "seq") -> DataFrame:
    """(sig_id, v_node, p_node): nodes of the vulnerable version mapped to the fixed one.

    Entry, exit and definition nodes map to the first node of their type. All others map one to one on equal code, type
    and degrees, the k-th such node to the k-th: the same as taking the first free one in turn. ``nodes``: fn_id, node_id,
    type, code, in_deg, out_deg and ``order``.
    """
    cols = ["node_id", "type", "code", "in_deg", "out_deg", order]
    v = sig.select("sig_id", F.col("v_id").alias("fn_id")).join(nodes, "fn_id").select("sig_id", *cols)
    p = sig.select("sig_id", F.col("p_id").alias("fn_id")).join(nodes, "fn_id").select("sig_id", *cols)
    heads = p.where(F.col("type").isin(SKELETON)).groupBy("sig_id", "type").agg(F.min_by("node_id", order).alias("p_node"))
    fixed = v.where(F.col("type").isin(SKELETON)).join(heads, ["sig_id", "type"]).select("sig_id", F.col("node_id").alias("v_node"), "p_node")
    key = ["sig_id", "code", "type", "in_deg", "out_deg"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    # what the skeleton has taken is no longer free
    v = v.join(fixed.select("sig_id", F.col("v_node").alias("node_id")), ["sig_id", "node_id"], "left_anti").withColumn("k", rank)
    p = p.join(fixed.select("sig_id", F.col("p_node").alias("node_id")), ["sig_id", "node_id"], "left_anti").withColumn("k", rank)
    rest = v.join(p.select(*key, "k", F.col("node_id").alias("p_node")), [*key, "k"]).select("sig_id", F.col("node_id").alias("v_node"), "p_node")
    return fixed.unionByName(rest)


def changed_nodes(sig: DataFrame, nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(sig_id, side, fn_id, node_id): nodes of either version without a counterpart; side v or p."""
    side = lambda s: sig.select("sig_id", F.col(f"{s}_id").alias("fn_id")).join(nodes.select("fn_id", "node_id"), "fn_id").join(mapping.select("sig_id", F.col(f"{s}_node").alias("node_id")), ["sig_id", "node_id"], "left_anti").select("sig_id", F.lit(s).alias("side"), "fn_id", "node_id")
    return side("v").unionByName(side("p"))


def induced_edges(chosen: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges both of whose ends are chosen; of parallel ones the smallest relation. ``chosen``: keys, fn_id, node_id."""
    a = chosen.select(*keys, "fn_id", F.col("node_id").alias("src"))
    b = chosen.select(*keys, "fn_id", F.col("node_id").alias("dst"))
    return edges.join(a, ["fn_id", "src"]).join(b, [*keys, "fn_id", "dst"]).groupBy(*keys, "fn_id", "src", "dst").agg(F.min("rel").alias("rel"))


def context_nodes(sig: DataFrame, mapping: DataFrame, grown: DataFrame, edges: DataFrame) -> DataFrame:
    """(sig_id, node_id): mapped nodes of the vulnerable version that touch a changed node, of it or through their image.

    ``grown``: sig_id, side, node_id of the changed subgraphs; nodes in them are no context.
    """
    both = edges.select("fn_id", F.col("src").alias("x"), F.col("dst").alias("y")).unionAll(edges.select("fn_id", "dst", "src")).distinct()
    v, p = (grown.where(F.col("side") == s).select("sig_id", F.col("node_id").alias("n")) for s in "vp")
    free = mapping.join(v.withColumnRenamed("n", "v_node"), ["sig_id", "v_node"], "left_anti").join(p.withColumnRenamed("n", "p_node"), ["sig_id", "p_node"], "left_anti")
    near = lambda s, g: g.join(sig.select("sig_id", F.col(f"{s}_id").alias("fn_id")), "sig_id").join(both.withColumnRenamed("x", "n"), ["fn_id", "n"]).select("sig_id", F.col("y").alias(f"{s}_node")).distinct()
    a = free.join(near("v", v), ["sig_id", "v_node"], "left_semi")
    b = free.join(near("p", p), ["sig_id", "p_node"], "left_semi")
    return a.unionByName(b).select("sig_id", F.col("v_node").alias("node_id")).distinct()


def expand(chosen: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen nodes (keys, fn_id, node_id) and their neighbours in both directions."""
    out = edges.select("fn_id", F.col("src").alias("node_id"), F.col("dst").alias("n")).unionAll(edges.select("fn_id", F.col("dst"), F.col("src")))
    more = chosen.join(out, ["fn_id", "node_id"]).select(*keys, "fn_id", F.col("n").alias("node_id"))
    return chosen.select(*keys, "fn_id", "node_id").unionByName(more).distinct()


def two_hop(edges: DataFrame) -> DataFrame:
    """(fn_id, node_id, hop2): nodes two steps from a node, following edge directions, other than the node itself."""
    e = edges.select("fn_id", "src", "dst").distinct()
    nxt = e.select("fn_id", F.col("src").alias("dst"), F.col("dst").alias("hop2"))
    return e.join(nxt, ["fn_id", "dst"]).where("src <> hop2").select("fn_id", F.col("src").alias("node_id"), "hop2").distinct()
