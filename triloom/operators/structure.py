"""Neighbourhood indexes of graph nodes, and node scores as column expressions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simple(edges: DataFrame) -> DataFrame:
    """The simple digraph: of parallel edges the smallest relation stays."""
    return edges.groupBy("fn_id", "src", "dst").agg(F.min("rel").alias("rel"))


def neighbourhood_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_id, node_id, label, degree, labels, links): degree in and out, distinct labels of successors, and how many edges
    successors have among themselves, halved and rounded down. ``edges`` of a simple digraph."""
    label = nodes.select("fn_id", F.col("node_id").alias("dst"), F.col("type").alias("l"))
    out = edges.join(label, ["fn_id", "dst"]).groupBy("fn_id", F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("l")).alias("labels"))
    ends = edges.select("fn_id", F.col("src").alias("node_id")).unionAll(edges.select("fn_id", "dst")).groupBy("fn_id", "node_id").agg(F.count("*").alias("degree"))
    hop = edges.select("fn_id", F.col("src").alias("node_id"), F.col("dst").alias("n"))
    two = hop.join(hop.select("fn_id", F.col("node_id").alias("n"), F.col("n").alias("m")), ["fn_id", "n"])
    links = two.join(hop.select("fn_id", "node_id", F.col("n").alias("m")), ["fn_id", "node_id", "m"], "left_semi").groupBy("fn_id", "node_id").agg(F.count("*").alias("links"))
    k = ["fn_id", "node_id"]
    rows = nodes.select(*k, F.col("type").alias("label")).join(ends, k, "left").join(out, k, "left").join(links, k, "left")
    return rows.select(*k, "label", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.floor(F.coalesce("links", F.lit(0)) / 2).alias("links"))


def direction_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_id, node_id, label, in_deg, out_deg, in_labels, out_labels, in_rels, out_rels)."""
    label = nodes.select("fn_id", "node_id", F.col("type").alias("l"))
    k = ["fn_id", "node_id"]

    def side(own: str, other: str, name: str) -> DataFrame:
        e = edges.select("fn_id", F.col(own).alias("me"), F.col(other).alias("node_id"), "rel").join(label, k)
        return e.groupBy("fn_id", F.col("me").alias("node_id")).agg(F.count("*").alias(f"{name}_deg"), F.array_sort(F.collect_set("l")).alias(f"{name}_labels"), F.array_sort(F.collect_set("rel")).alias(f"{name}_rels"))

    rows = nodes.select(*k, F.col("type").alias("label")).join(side("dst", "src", "in"), k, "left").join(side("src", "dst", "out"), k, "left")
    none = F.array().cast("array<string>")
    return rows.select(*k, "label", *[F.coalesce(f"{n}_deg", F.lit(0)).alias(f"{n}_deg") for n in ("in", "out")], *[F.coalesce(f"{n}_{c}", none).alias(f"{n}_{c}") for c in ("labels", "rels") for n in ("in", "out")])


def important_nodes(index: DataFrame, share: float = 0.2) -> DataFrame:
    """The ``share`` of each graph's nodes, at least one, with the highest degree; of equals the larger id as a string."""
    each = Window.partitionBy("fn_id")
    ranked = index.withColumns({"r": F.row_number().over(each.orderBy(F.desc("degree"), F.desc("node_id"))), "n": F.count("*").over(each)})
    return ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))).drop("r", "n")


def tolerant_score(q: str = "q", t: str = "t", r: float = 0.1) -> Column:
    """Score 0 to 2 of a query node against a target node (columns q_label, q_degree, q_labels, q_links and t_*), which may
    miss a share ``r`` of the query's neighbours and of the links among them."""
    c = lambda s, n: F.col(f"{s}_{n}")
    deg, may = c(q, "degree"), F.floor(c(q, "degree") * r)
    links_may = may * F.floor((may - 1) / 2) + (deg - may) * may
    miss = F.size(c(q, "labels")) - F.size(F.array_intersect(c(q, "labels"), c(t, "labels")))
    lost = F.greatest(F.lit(0), c(q, "links") - c(t, "links"))
    f_nb = F.when(deg == 0, 0.0).otherwise(miss / deg)
    f_links = F.when(c(q, "links") == 0, 0.0).otherwise(lost / c(q, "links"))
    fails = (c(q, "label") != c(t, "label")) | (c(t, "degree") < deg - may) | (miss > may) | (c(t, "links") < c(q, "links") - links_may)
    return F.when(fails, 0.0).when(miss == 0, 2.0 - f_links).otherwise(2.0 - (f_nb + f_links / miss))


def dominates(q: str = "q", t: str = "t") -> Column:
    """Whether a target node covers a query node: equal labels, no smaller degrees, and all its neighbour labels and relations."""
    c = lambda s, n: F.col(f"{s}_{n}")
    covers = lambda n: F.size(F.array_except(c(q, n), c(t, n))) == 0
    return (c(q, "label") == c(t, "label")) & (c(q, "in_deg") <= c(t, "in_deg")) & (c(q, "out_deg") <= c(t, "out_deg")) & covers("in_labels") & covers("out_labels") & covers("in_rels") & covers("out_rels")


def cover_score(q: str = "q", t: str = "t", r: float = 1.0) -> Column:
    """The share of a query node's degrees, neighbour labels and relations that a target node has too; 0 below ``r`` or for another label.

    With ``r`` of 1 it is 1 where :func:`dominates` holds, and 0 elsewhere. A node without edges is covered by any of its label.
    """
    c = lambda s, n: F.col(f"{s}_{n}")
    counts, lists = ("in_deg", "out_deg"), ("in_labels", "out_labels", "in_rels", "out_rels")
    lacking = [F.greatest(c(q, n) - c(t, n), F.lit(0)) for n in counts] + [F.size(F.array_except(c(q, n), c(t, n))) for n in lists]
    asked = [c(q, n) for n in counts] + [F.size(c(q, n)) for n in lists]
    share = F.coalesce(1.0 - F.try_divide(sum(lacking, F.lit(0)) * 1.0, sum(asked, F.lit(0))), F.lit(1.0))
    return F.when((c(q, "label") != c(t, "label")) | (share < r), 0.0).otherwise(share)


def node_pairs(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Query and target nodes with equal labels of each pair (q_fn, t_fn), their index columns prefixed q_ and t_."""
    side = lambda s: index.select(*[F.col(x).alias(f"{s}_{'fn' if x == 'fn_id' else 'node' if x == 'node_id' else x}") for x in index.columns])
    met = pairs.join(side("q"), "q_fn").join(side("t").withColumnRenamed("t_label", "_l"), ["t_fn"])
    return met.where(F.col("q_label") == F.col("_l")).withColumnRenamed("_l", "t_label")


def edge_pattern(nodes: DataFrame, edges: DataFrame, pattern: list[tuple[str, str, str]], labels: dict[str, str]) -> DataFrame:
    """Induced matches of a small pattern, as one join for each edge: fn_id and a column for each pattern node.

    ``labels``: type of each pattern node; ``pattern``: edges (from, relation, to), each after the first touching a node
    named before. Nodes of a match differ, and have no edges among them but those of the pattern.
    """
    first = True
    out: DataFrame | None = None
    for a, rel, b in pattern:
        e = edges.where(F.col("rel") == rel).select("fn_id", F.col("src").alias(a), F.col("dst").alias(b)).distinct()
        out = e if first else out.join(e, [c for c in ("fn_id", a, b) if c in out.columns])
        first = False
    for name, kind in labels.items():
        out = out.join(nodes.where(F.col("type") == kind).select("fn_id", F.col("node_id").alias(name)), ["fn_id", name], "left_semi")
    names = sorted(labels)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            out = out.where(F.col(x) != F.col(y))
    allowed = {(a, b): {r for x, r, y in pattern if (x, y) == (a, b)} for a in names for b in names if a != b}
    for (a, b), rels in allowed.items():
        other = edges.where(~F.col("rel").isin(list(rels))) if rels else edges
        out = out.join(other.select("fn_id", F.col("src").alias(a), F.col("dst").alias(b)).distinct(), ["fn_id", a, b], "left_anti")
    return out.select("fn_id", *names)
