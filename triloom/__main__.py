"""python -m triloom COMMAND ...: the pipeline over tables of funcs, nodes and triples in Parquet.

mine LOG DIFFS BLOBS OUT [DONE]  commits of CVEs (JSON lines), their diffs (<repo>/<hash>.diff) and blobs (Parquet: blob_id, content);
                           OUT/commits, OUT/mined, OUT/counters, OUT/changed, OUT/src, OUT/names; DONE: an earlier OUT, what it has is left out
ingest PARSED OUT [SRC]    parser output (nodes.csv, edges.csv by file) to funcs, nodes, edges, triples and vectors; OUT/rejects,
                           OUT/counts. With SRC (sources and funcnames) only named functions of CVEs with both sides, and their code
signatures DATA OUT        build signatures of all fixed functions; OUT/sig, OUT/sig_parts, OUT/sig_vec, OUT/stats
pair DATA VULN PATCH OUT   build the signature of one pair of functions
scan DATA SIG OUT e|a      score targets against signatures, exactly or approximately; OUT/scores, OUT/hits
match SIG DATA TARGET      print both scores of one target by every signature in SIG
evaluate DATA SIG OUT [LABELS]   verdicts and rates of the evaluator's hits; OUT/verdicts, OUT/rates, OUT/rates.txt, OUT/mods
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from triloom.functions.scalars import extension, is_scan_hit, source_key
from triloom.operators import dense, evaluate, history, ingest, match, signature, triples
from triloom.session import cut, table
from triloom.sources import readers, writers


def mine(spark: SparkSession, log: str, diffs: str, blobs: str, out: str, done: str | None = None) -> None:
    commits = cut(history.cve_commits(readers.commit_log(spark, log)), "commits")
    covered = spark.read.parquet(f"{done}/mined").where("reason is null").select("repo", "cve") if done else None
    lines = cut(readers.diff_lines(spark, diffs).join(commits.select("repo", "hash"), ["repo", "hash"], "left_semi"), "diffs")
    judged = history.mined(lines, ["repo", "hash"], covered).join(commits.select("repo", "hash", "seq", "author_ts"), ["repo", "hash"])
    parsed = cut(history.parse_diffs(lines, ["repo", "hash"]), "parsed")
    # a commit without a changed function is skipped, and blocks no other
    judged = judged.join(parsed.select("repo", "hash").distinct().withColumn("some", F.lit(True)), ["repo", "hash"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("some").isNull(), "no function"))).drop("some")
    first = history.first_productive(judged.where("reason is null"), ["repo", "cve"], ["seq"]).select("repo", "hash", F.lit(True).alias("first"))
    judged = cut(judged.join(first, ["repo", "hash"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("first").isNull(), "CVE covered already"))).drop("first"), "mined")
    changed = cut(parsed.join(judged.where("reason is null").select("repo", "hash", "cve", "author_ts"), ["repo", "hash"]), "changed")
    versions = history.with_versions(changed.withColumn("hsh", F.concat_ws("_", "hash", "author_ts")), spark.read.parquet(blobs), ["repo", "cve", "hsh"])
    writers.commit_list(commits, f"{out}/commits")
    for name, df in (("mined", judged), ("counters", history.counters(judged, ["repo"])), ("changed", changed)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    writers.sources(versions, f"{out}/src")
    writers.function_names(changed, f"{out}/names")


def ingestion(spark: SparkSession, parsed: str, out: str, src: str | None = None) -> None:
    checked = cut(readers.node_rows(spark, parsed), "checked")
    key = source_key(F.col("nodes_path"), 1)
    nodes = checked.where("reason is null").select(F.col("nodes_path").alias("file_id"), "line_no", "key", "type", "code", "location", "function_id", *[c.alias(n) for n, c in key.items()])
    edges = cut(readers.edge_rows(spark, parsed), "edges")
    names = None
    if src:
        names = cut(readers.function_names(spark, src), "names")
        files = nodes.select("file_id", "repo", "cve", "role").distinct()
        nodes = nodes.join(ingest.complete(files, ["repo", "cve"]), ["repo", "cve"], "left_semi").join(names.select("repo", "cve").distinct(), ["repo", "cve"], "left_semi")
    nodes = cut(nodes, "rows")
    functions, own, links = (cut(x, n) for x, n in zip(ingest.graphs(nodes, edges, names), ("functions", "nodes", "links")))
    at = {n: c for n, c in source_key(F.col("file_id"), 1).items()}
    parts = [F.coalesce(c, F.lit("-")) for c in at.values()]
    path = F.concat_ws("/", *parts, F.lit("graph"), F.concat("func", F.lit(".gpickle")))
    funcs = functions.select("fn_id", *[c.alias(n) for n, c in at.items()], "func", "location", path.alias("path"))
    if src:
        texts = readers.blobs(spark, src).select(*[c.alias(n) for n, c in source_key(F.col("path")).items()], "content")
        code = readers.functions_of(texts, funcs.select("fn_id", *at, "location")).select("fn_id", "code")
        funcs = funcs.join(code, "fn_id", "left")
    else:
        funcs = funcs.withColumn("code", F.lit(None).cast("string"))
    funcs = cut(funcs.withColumns({"ext": extension(F.col("file")), "loaded_at": F.lit(None).cast("timestamp")}), "funcs")
    where = funcs.select("fn_id", "repo", "role")
    placed = lambda df: df.join(where, "fn_id")
    writers.graph_tables({"funcs": funcs, "nodes": placed(own), "edges": placed(links), "triples": placed(triples.tripleize(links, own)), "vectors": placed(triples.vectorize(own, links))}, out, ["repo", "role"])
    checked.where("reason is not null").write.mode("overwrite").parquet(f"{out}/rejects")
    counts = functions.groupBy("file_id").agg(F.count("*").alias("n_functions")).join(ingest.dropped_edges(own.join(functions.select("fn_id", "file_id"), "fn_id").select("file_id", F.col("fn_id").alias("fn_key"), F.col("node_id").alias("key")), edges), "file_id", "full")
    counts.fillna(0).write.mode("overwrite").parquet(f"{out}/counts")


def signatures(spark: SparkSession, data: str, out: str) -> None:
    tg = signature.targets(table(spark, data, "funcs"))
    sig = cut(signature.pairs(tg), "signatures")
    parts = cut(signature.parts(sig, table(spark, data, "triples")), "parts")
    vectors = table(spark, data, "vectors").join(sig.select(F.col("v_id").alias("fn_id"), "sig_id"), "fn_id").select("sig_id", "vec").distinct()
    writers.signature_tables(sig, signature.accepted(parts), vectors, out)
    writers.text(writers.statistics(signature.stats(sig, parts, table(spark, data, "nodes").select("fn_id", "node_id").distinct()), sig), f"{out}/stats")
    signature.missing(tg).write.mode("overwrite").parquet(f"{out}/missing")


def pair(spark: SparkSession, data: str, vuln: str, patch: str, out: str) -> None:
    tg = signature.targets(table(spark, data, "funcs").where(F.col("fn_id").isin(vuln, patch)))
    sides = {r.fn_id: r for r in tg.collect()}  # at most two rows
    if set(sides) != {vuln, patch}:
        raise SystemExit("one of the functions isn't there")
    sig = tg.where(F.col("fn_id") == vuln).select(F.col("fn_id").alias("sig_id"), *signature.KEY, F.col("fn_id").alias("v_id"), F.lit(patch).alias("p_id"))
    own = table(spark, data, "triples").where(F.col("fn_id").isin(vuln, patch))
    parts = cut(signature.parts(sig, own), "parts")
    vectors = table(spark, data, "vectors").where(F.col("fn_id") == vuln).select(F.lit(vuln).alias("sig_id"), "vec").distinct()
    kept = signature.accepted(parts)
    if kept.isEmpty():
        print("a part is empty: no signature")
    writers.signature_tables(sig, kept, vectors, out)
    writers.text(writers.statistics(signature.stats(sig, parts, table(spark, data, "nodes").select("fn_id", "node_id").distinct()), sig), f"{out}/stats")


def ad_hoc(spark: SparkSession, sigs: str, data: str, target: str) -> None:
    _, parts, _ = readers.signature_db(spark, sigs, vectors=False)
    own = cut(table(spark, data, "triples").where(F.col("fn_id") == target), "target")
    ids = parts.select("sig_id").distinct()
    pairs = ids.withColumn("target_id", F.lit(target))
    for how, scores in (("exact", match.score_pairs(pairs, parts, own)), ("approximate", match.score_fuzzy(pairs, parts, own))):
        for r in scores.orderBy("sig_id").toLocalIterator():
            print(how, r.sig_id, r.cvg, r.pvg, r.nvg)


def scan(spark: SparkSession, data: str, sigs: str, out: str, how: str) -> None:
    if how not in ("e", "a"):
        raise SystemExit("exact (e) or approximate (a) matching")
    tg = signature.targets(table(spark, data, "funcs"))
    (sig, parts, _), rows = readers.signature_db(spark, sigs, vectors=False), table(spark, data, "triples")
    if how == "e":
        scores, hits = dense.score_exact(parts, rows), match.hits_scan(parts, rows)
    else:
        scores = cut(dense.score_all(parts, rows), "scores")
        hits = scores.where(is_scan_hit(F.col("cvg"), F.col("pvg"), F.col("nvg")))
    writers.text(match.score_lines(match.every_pair(scores, parts, tg), sig, tg), f"{out}/scores")
    writers.text(match.hit_lines(hits, sig, tg), f"{out}/hits")


def evaluation(spark: SparkSession, data: str, sigs: str, out: str, labels: str | None = None) -> None:
    sig, parts, _ = readers.signature_db(spark, sigs, vectors=False)
    tg = cut(evaluate.with_signature(signature.targets(table(spark, data, "funcs")), sig), "targets")
    hits = cut(match.hits_eval(parts, table(spark, data, "triples")), "hits")
    judged = cut(evaluate.verdicts(tg, sig, hits, readers.manual_labels(spark, labels)), "verdicts")
    judged.write.mode("overwrite").parquet(f"{out}/verdicts")
    rates = cut(evaluate.rates(evaluate.confusion(judged)), "rates")
    rates.write.mode("overwrite").parquet(f"{out}/rates")
    writers.text(evaluate.rate_lines(rates), f"{out}/rates.txt")
    mods = evaluate.clone_types(evaluate.line_diff(evaluate.modified(tg)))
    writers.modifications(evaluate.modified_verdicts(mods, sig, hits), f"{out}/mods")


def main(args: list[str]) -> None:
    commands = {"mine": (mine, (4, 5)), "ingest": (ingestion, (2, 3)), "pair": (pair, (4,)), "match": (ad_hoc, (3,)), "signatures": (signatures, (2,)), "scan": (scan, (4,)), "evaluate": (evaluation, (3, 4))}
    if not args or args[0] not in commands or len(args) - 1 not in commands[args[0]][1]:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.appName("triloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    commands[args[0]][0](spark, *args[1:])


if __name__ == "__main__":
    main(sys.argv[1:])
