"""From parser rows to function graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(nodes: DataFrame, file: str = "file_id", order: str = "row_no", names: DataFrame | None = None) -> DataFrame:
    """Give each node row the function it belongs to: the last Function row before it in its file.

    ``nodes``: file, order, key, type, code, location, function_id. Rows before a file's first function, and Function rows
    themselves, are dropped; with ``names`` (func, and what keys of ``nodes`` the list is for) only those functions are
    kept, and rows after another one are dropped too. Adds fn_no (its row), fn_key, func and fn_location. A file is ordered
    in one task, as its rows depend on their order.
    """
    start = F.col("type") == "Function"
    upto = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.last(F.when(start, F.struct(F.col(order).alias("fn_no"), F.col("key").alias("fn_key"), F.col("code").alias("func"), F.col("location").alias("fn_location"))), ignorenulls=True).over(upto)
    rows = nodes.withColumn("_head", head).where(~start & F.col("_head").isNotNull()).select("*", "_head.*").drop("_head")
    return rows if names is None else listed(rows, names)


def listed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the functions in ``names``: func, and those other columns that ``rows`` has too."""
    on = [c for c in names.columns if c in rows.columns]
    return rows.join(names.select(*on).distinct(), on, "left_semi")


def complete(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (such as repo and cve) that have both a vulnerable and a fixed file. ``files``: keys, role."""
    per = files.groupBy(*keys).agg(F.count_if(F.col("role") == "vuln").alias("v"), F.count_if(F.col("role") == "patch").alias("p"))
    return per.where("v > 0 and p > 0").select(*keys)


def graphs(nodes: DataFrame, edges: DataFrame, names: DataFrame | None = None, file: str = "file_id", order: str = "line_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions (file, fn_id, func, location), their nodes (fn_id, node_id, type, code, function_id, seq) and their edges (fn_id, src, dst, rel).

    ``nodes``: file, order, key, type, code, location, function_id in the parser's order; ``edges``: file, src, dst, rel.
    Of functions of one name in a file, and of rows with one key in a function, the last counts; a function may have no
    nodes. ``fn_id`` is the file and the name. Edges that leave their function are dropped.
    """
    heads = nodes.where("type = 'Function'").withColumnRenamed("code", "func")
    heads = heads if names is None else listed(heads, names)
    last = heads.groupBy(file, "func").agg(F.max(F.struct(F.col(order).alias("no"), "location")).alias("l"))
    functions = last.select(file, F.concat(F.col(file), F.lit("#"), "func").alias("fn_id"), "func", F.col("l.location").alias("location"), F.col("l.no").alias("fn_no"))
    rows = sessionize(nodes.select(file, order, "key", "type", "code", "location", "function_id"), file, order).join(functions.select(file, "fn_no", "fn_id"), [file, "fn_no"])
    own = last_wins(rows.select(file, "fn_id", "key", order, "type", "code", "function_id"), [file, "fn_id", "key"], [order])
    kept = attach_edges(own.select(file, F.col("fn_id").alias("fn_key"), "key"), edges, file).select(F.col("fn_key").alias("fn_id"), "src", "dst", "rel")
    return functions.drop("fn_no"), own.select("fn_id", F.col("key").alias("node_id"), "type", F.coalesce("code", F.lit("")).alias("code"), "function_id", F.col(order).alias("seq")), kept


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``; a map-side maximum, so a hot key costs one row for each task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return best.select(*keys, "_last.*")


def attach_edges(nodes: DataFrame, edges: DataFrame, file: str = "file_id") -> DataFrame:
    """Edges within functions: file-scoped join on the source key, kept only if the target is a node of the same function.

    ``nodes``: file, fn_key, key; ``edges``: file, src, dst, rel. Edges are a bag: parallel ones all stay.
    """
    own = nodes.select(file, "fn_key", F.col("key").alias("src"))
    ends = nodes.select(file, "fn_key", F.col("key").alias("dst"))
    return edges.join(own, [file, "src"]).join(ends, [file, "fn_key", "dst"]).select(file, "fn_key", "src", "dst", "rel")


def dropped_edges(nodes: DataFrame, edges: DataFrame, file: str = "file_id") -> DataFrame:
    """For each file, edges read and edges that :func:`attach_edges` keeps."""
    kept = attach_edges(nodes, edges, file).groupBy(file).agg(F.count("*").alias("n_kept"))
    return edges.groupBy(file).agg(F.count("*").alias("n_edges")).join(kept, file, "left").select(file, "n_edges", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))
