"""Readers for what the pipeline takes in: parser output, lists, diffs, trees of files, written tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.scalars import graph_key
from triloom.operators.rejects import check_node_lines
from triloom.session import address, arrow, cut


def lines(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """(file_id, line_no, line) of all text files below ``path``, numbered from 1; the order of lines is part of the data.

    Lines are split where the file is read, so a file must fit in a task; a last empty line is none.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    rows = files.select(F.col("_metadata.file_path").alias("file_id"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("p", "line"))
    return rows.select("file_id", (F.col("p") + 1).alias("line_no"), "line")


def node_rows(spark: SparkSession, path: str) -> DataFrame:
    """Checked rows of all ``nodes.csv`` files below ``path``: see :func:`check_node_lines`."""
    raw = lines(spark, path, "nodes.csv").withColumnRenamed("file_id", "nodes_path").withColumn("line_id", F.monotonically_increasing_id())
    return check_node_lines(raw)


def edge_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, src, dst, rel) of all ``edges.csv`` files below ``path``: tab-separated, the header unread. Edges need no order, so files are split freely."""
    rows = spark.read.schema("src string, dst string, rel string").option("recursiveFileLookup", True).option("pathGlobFilter", "edges.csv").csv(path, sep="\t", header=True, quote='"', escape='"', enforceSchema=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"edges\.csv$", "nodes.csv").alias("file_id"), "src", "dst", "rel").where("src is not null and dst is not null")


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a list separated by white space; lines with fewer fields are left out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(f[0].alias("name"), F.try_element_at(f, F.lit(2)).alias("url")).where("url is not null")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from JSON lines: repo, seq, hash, author_ts, message, is_merge, parents."""
    return spark.read.schema("repo string, seq long, hash string, author_ts long, message string, is_merge boolean, parents array<string>").json(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files by name, as bytes and as text."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path"), F.decode("content", "UTF-8").alias("content"), "length")


def _place(uri: str):
    """pyarrow's file system of an address, the path in it, and what made the address of such paths."""
    from pyarrow import fs

    if ":" not in uri:
        return fs.LocalFileSystem(), uri, ""
    system, base = fs.FileSystem.from_uri(address(uri))
    return system, base, uri.removesuffix("/")[: len(uri.removesuffix("/")) - len(base.removesuffix("/"))]


def _listing(batches):
    """Rows (path) of folders become rows (path, is_dir, length) of what they hold."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, base, before = _place(uri)
            found = system.get_file_info(fs.FileSelector(base))
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([before + f.path for f in part], pa.string()), pa.array([f.type == fs.FileType.Directory for f in part]), pa.array([f.size or 0 for f in part], pa.int64())], ["path", "is_dir", "length"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of all files below ``path``. Folders are listed in tasks, one level after the other, so the driver holds no
    list; the entries of one folder are listed in one task. Links aren't followed into folders twice."""
    level = spark.createDataFrame([(path.removesuffix("/") or "/",)], "path string")
    found = None
    while True:
        held = cut(level.repartition(min(4096, 4 * spark.sparkContext.defaultParallelism)).transform(arrow, _listing, "path string, is_dir boolean, length long"), "listing")
        files = held.where("not is_dir").select("path", "length")
        found = files if found is None else found.unionByName(files)
        level = held.where("is_dir").select("path")
        if level.isEmpty():
            return found


def _bodies(batches):
    """Rows (path, length) become rows with the file's bytes."""
    import pyarrow as pa

    for batch in batches:
        held, size = [], 0
        for uri, n in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            system, base, _ = _place(uri)
            with system.open_input_stream(base) as f:
                held.append((uri, f.read()))
            size += n
            if size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["path", "content"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["path", "content"])


def tiny_files(spark: SparkSession, path: str, name: str = "*", task_bytes: int = 128 << 20) -> DataFrame:
    """All files below ``path`` as rows for :func:`triloom.operators.compact.compact`: file_no (from the path), path, func (the name's stem), n_bytes, body.

    ``name`` may hold ``*`` and ``?``. Neither listing nor reading passes through the driver. Files of no bytes hold no
    record and are left out. A task reads about ``task_bytes``, and no more than 20,000 files.
    """
    last = F.element_at(F.split("path", "/"), -1)
    like = "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name) + "$"
    listed = list_files(spark, path).where((F.col("length") > 0) & last.rlike(like))
    n, total = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    rows = listed.repartition(max(1, -(-total // task_bytes), -(-n // 20_000), min(n, spark.sparkContext.defaultParallelism))).transform(arrow, _bodies, "path string, content binary")
    return rows.select(F.xxhash64("path").alias("file_no"), "path", F.regexp_replace(last, r"\.[^.]*$", "").alias("func"), F.length("content").cast("long").alias("n_bytes"), F.col("content").cast("string").alias("body"))


def function_names(spark: SparkSession, path: str) -> DataFrame:
    """(repo, cve, func) of ``<repo>/<cve>/funcnames`` files: names trimmed at the right, blank ones dropped."""
    rows = lines(spark, path, "funcnames").select(F.split("file_id", "/").alias("p"), F.rtrim("line").alias("func")).where("func <> ''")
    return rows.select(F.element_at("p", -3).alias("repo"), F.element_at("p", -2).alias("cve"), "func").distinct()


def manual_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """(line_no, verdict, cve, path_part) of a text file with fields separated by one blank; without a file, no labels."""
    schema = "line_no int, verdict string, cve string, path_part string"
    if path is None:
        return spark.createDataFrame([], schema)
    f = F.split(F.rtrim("line"), " ")
    return lines(spark, path).select("line_no", f[0].alias("verdict"), F.try_element_at(f, F.lit(2)).alias("cve"), F.try_element_at(f, F.lit(3)).alias("path_part")).where("path_part is not null")


def tree(spark: SparkSession, path: str, suffix: str = "*.gpickle") -> DataFrame:
    """Key columns of the graph files below ``path``, from their names alone; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path).select("path")
    return files.select("path", *[c.alias(n) for n, c in graph_key(F.col("path")).items() if n != "at"])


def functions_of(sources: DataFrame, located: DataFrame) -> DataFrame:
    """Source text of functions: ``located`` (file key columns, func, location ``l:c:start:end``) cut from ``sources`` (same key, content)."""
    keys = [c for c in located.columns if c in sources.columns]
    at = F.split("location", ":")
    start, end = (F.try_element_at(at, F.lit(i)).try_cast("int") for i in (3, 4))
    return located.join(sources, keys).select(*located.columns, F.expr("content").alias("content"), start.alias("_s"), end.alias("_e")).select(*located.columns, F.substring("content", F.col("_s") + 1, F.col("_e") - F.col("_s") + 1).alias("code"))


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """(repo, hash, line_no, line) of diff texts in ``<repo>/<hash>.diff`` files."""
    p = F.split("file_id", "/")
    return lines(spark, path, "*.diff").select(F.element_at(p, -2).alias("repo"), F.regexp_replace(F.element_at(p, -1), r"\.diff$", "").alias("hash"), "line_no", "line")


def signature_db(spark: SparkSession, path: str, vectors: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(sig, sig_parts, sig_vec) as written by :func:`triloom.sources.writers.signature_tables`. A signature that lacks one of its parts is
    an error, as is a missing table; that of vectors only if it is wanted."""
    sig, parts = (spark.read.parquet(f"{path}/{t}") for t in ("sig", "sig_parts"))
    vec = spark.read.parquet(f"{path}/sig_vec") if vectors else None
    held = parts.groupBy("sig_id").agg(F.count_distinct("part").alias("n"))
    torn = held.where("n < 3").select("sig_id").unionByName(held.join(sig, "sig_id", "left_anti").select("sig_id")).limit(10).collect()
    if torn:
        raise ValueError(f"incomplete signatures: {', '.join(sorted(str(r.sig_id) for r in torn))}")
    return sig.join(held, "sig_id", "left_semi"), parts, vec


def graph_db(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that :func:`triloom.sources.writers.graph_tables` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in ("funcs", "nodes", "edges", "triples", "vectors")}
