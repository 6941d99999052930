"""Triple sets and type-count vectors of function graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.functions.vocab import BOUNDARY_TYPES, VECTOR_DIMS


def with_endpoints(edges: DataFrame, nodes: DataFrame, fn: str = "fn_id") -> DataFrame:
    """Edges with type and code of both ends (type1, code1, type2, code2). Both joins and what follows are by function."""
    a = nodes.select(fn, F.col("node_id").alias("src"), F.col("type").alias("type1"), F.col("code").alias("code1"))
    b = nodes.select(fn, F.col("node_id").alias("dst"), F.col("type").alias("type2"), F.col("code").alias("code2"))
    return edges.join(a, [fn, "src"]).join(b, [fn, "dst"])


def tripleize(edges: DataFrame, nodes: DataFrame, fn: str = "fn_id") -> DataFrame:
    """The distinct triples (fn, a, rel, b) of each function.

    An edge between nodes that are neither entry nor exit gives (type, rel, type), and with each end's code, where it has
    one, in place of its type: up to four triples. Null codes count as empty. Slots carry no mark of what they hold.
    """
    e = with_endpoints(edges, nodes, fn).where(~F.col("type1").isin(BOUNDARY_TYPES) & ~F.col("type2").isin(BOUNDARY_TYPES))
    # expanded before the exchange, made distinct map-side by the aggregate
    left = F.when(F.coalesce("code1", F.lit("")) != "", F.array("type1", "code1")).otherwise(F.array("type1"))
    right = F.when(F.coalesce("code2", F.lit("")) != "", F.array("type2", "code2")).otherwise(F.array("type2"))
    return e.select(fn, F.explode(left).alias("a"), "rel", right.alias("_r")).select(fn, "a", "rel", F.explode("_r").alias("b")).distinct()


def edge_counts(edges: DataFrame, fn: str = "fn_id", dedup_parallel: bool = False) -> DataFrame:
    """(fn, rel, n): edges by type. Each of k parallel edges between two nodes counts k times, as the vectors define it;
    with ``dedup_parallel`` every edge counts once."""
    if dedup_parallel:
        return edges.groupBy(fn, "rel").agg(F.count("*").alias("n"))
    per = edges.groupBy(fn, "src", "dst", "rel").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(fn, "src", "dst"))  # bounded by the number of edge types
    return per.withColumn("n", F.col("c") * total).groupBy(fn, "rel").agg(F.sum("n").alias("n"))


def node_counts(nodes: DataFrame, fn: str = "fn_id") -> DataFrame:
    return nodes.groupBy(fn, "type").agg(F.count("*").alias("n"))


def vectorize(nodes: DataFrame, edges: DataFrame, fn: str = "fn_id", dedup_parallel: bool = False) -> DataFrame:
    """(fn, vec): the 79 counts of every function that has nodes; types outside the vocabulary are ignored."""
    counts = node_counts(nodes, fn).withColumnRenamed("type", "dim").unionByName(edge_counts(edges, fn, dedup_parallel).withColumnRenamed("rel", "dim"))
    place = F.create_map(*[F.lit(x) for i, d in enumerate(VECTOR_DIMS) for x in (d, i)])
    per = counts.where(F.col("dim").isin(VECTOR_DIMS)).withColumn("at", place[F.col("dim")]).groupBy(fn).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))  # at most 79 entries
    every = nodes.select(fn).distinct()
    value = F.transform(F.sequence(F.lit(0), F.lit(len(VECTOR_DIMS) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return every.join(per, fn, "left").select(fn, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0).cast("long"), len(VECTOR_DIMS))).otherwise(value).alias("vec"))
