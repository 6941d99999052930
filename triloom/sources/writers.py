"""Writers for the pipeline's tables and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_tables(tables: dict[str, DataFrame], path: str, by: list[str]) -> None:
    """Parquet tables of function graphs (such as funcs, nodes, edges, triples, vectors), each partitioned by those of ``by`` (such
    as repo and role) that it has. A repo with most of all rows is split over many tasks."""
    for name, df in tables.items():
        keys = [c for c in by if c in df.columns]
        out = df.hint("rebalance", *keys) if keys else df
        out.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/{name}.parquet")


def signature_tables(sig: DataFrame, parts: DataFrame, vectors: DataFrame, path: str) -> None:
    for name, df in (("sig", sig), ("sig_parts", parts), ("sig_vec", vectors)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def sources(df: DataFrame, path: str) -> None:
    """Versioned source files (repo, cve, role, hsh, file, content), partitioned by repo and role."""
    df.write.mode("overwrite").partitionBy("repo", "role").parquet(path)


def function_names(changed: DataFrame, path: str, last_file: bool = False) -> None:
    """Names of changed functions, each once and in order, as ``<path>/repo=<repo>/cve=<cve>`` text. ``changed``: repo, cve, segment, funcs.

    Names of all files of a CVE are kept; with ``last_file`` only those of its last one.
    """
    rows = changed
    if last_file:
        rows = rows.groupBy("repo", "cve").agg(F.max_by("funcs", F.struct("segment", "funcs")).alias("funcs"))
    names = rows.select("repo", "cve", F.explode("funcs").alias("value")).where("value <> ''").distinct()
    names.hint("rebalance", "repo", "cve").sortWithinPartitions("repo", "cve", "value").write.mode("overwrite").partitionBy("repo", "cve").text(path)


def commit_list(commits: DataFrame, path: str) -> None:
    """One line for each commit in the log's order, below ``repo=<repo>``, unless the list is there already."""
    commits.hint("rebalance", "repo").sortWithinPartitions("repo", "seq").select("repo", F.col("hash").alias("value")).write.mode("ignore").partitionBy("repo").text(path)


def text(df: DataFrame, path: str) -> None:
    """One column ``value`` as lines: score files, hit files, statistics."""
    df.write.mode("overwrite").text(path)


def modifications(df: DataFrame, path: str) -> None:
    """``path added clone_type verdict`` separated by blanks."""
    df.select("path", "added", "clone_type", "verdict").write.mode("overwrite").csv(path, sep=" ", quote="")


def statistics(stats: DataFrame, sig: DataFrame) -> DataFrame:
    """Lines of name, node counts of both versions and sizes of the three parts, separated by tabs."""
    named = stats.join(sig.select("sig_id", F.concat_ws("/", "repo", "cve", "hsh", "file", "func").alias("name")), "sig_id")
    return named.select(F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in ("nodes_v", "nodes_p", "n_cvg", "n_pvg", "n_nvg")]).alias("value"))


def once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless ``path`` is there already, and read it: the cached result of an earlier run is reused."""
    spark = df.sparkSession
    df.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)
