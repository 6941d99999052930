"""Queries that write what the pipeline stores and read it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from triloom.functions import scalars
from triloom.operators import evaluate, history, ingest, match, signature, triples
from triloom.plans import graphs
from triloom.plans.projections import PARTS_SQL, SCORE_SQL, TARGET_SQL
from triloom.session import address, cut, scratch, table
from triloom.sources import readers, writers


def store_graphs(spark, d):
    """Rows of each table of function graphs, by role."""
    rows, edges = graphs._parsed(spark, d)
    functions, nodes, links = (cut(x, n) for x, n in zip(ingest.graphs(rows, edges), ("functions", "nodes", "links")))
    key = scalars.source_key(F.col("file_id"), 1)
    funcs = functions.select("fn_id", *[c.alias(n) for n, c in key.items()], "func", "location")
    placed = lambda df: df.join(funcs.select("fn_id", "repo", "role"), "fn_id")
    at = scratch(spark, "graphs")
    writers.graph_tables({"funcs": funcs, "nodes": placed(nodes), "edges": placed(links), "triples": placed(triples.tripleize(links, nodes)), "vectors": placed(triples.vectorize(nodes, links))}, at, ["repo", "role"])
    out = None
    for name, df in readers.graph_db(spark, at).items():
        per = df.groupBy("role").agg(F.lit(name).alias("kept"), F.count("*").alias("n_rows"))
        out = per if out is None else out.unionByName(per)
    return out


def store_signatures(spark, d):
    _, sig, parts = graphs._signatures(spark, d)
    at = scratch(spark, "signatures")
    vectors = table(spark, d, "vectors").where("vec is not null").join(sig.select(F.col("v_id").alias("fn_id"), "sig_id"), "fn_id").groupBy("sig_id").agg(F.min("vec").alias("vec"))
    writers.signature_tables(sig, parts, vectors, at)
    known, held, vec = readers.signature_db(spark, at)
    n = held.groupBy("sig_id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in match.PARTS])
    return known.join(n, "sig_id").join(vec.select("sig_id", F.size("vec").alias("n_vec")), "sig_id", "left").select("sig_id", "cve", "func", "n_cvg", "n_pvg", "n_nvg", "n_vec")


def store_sources(spark, d):
    src = table(spark, d, "vuln_patch_src_db").where("repo is not null and role is not null").select("repo", "cve", "role", "hsh", F.col("curr_file").alias("file"), "content")
    at = scratch(spark, "sources")
    writers.sources(src, at)
    return spark.read.parquet(at).groupBy("repo", "role").agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"))


def store_names(spark, d):
    """Function names of each CVE, by way of the text files."""
    tg = graphs._targets(spark, d).where("cve is not null and role = 'patch'")
    at = scratch(spark, "names")
    writers.function_names(tg.select("repo", "cve", F.lit(1).alias("segment"), F.array("func").alias("funcs")), at)
    return spark.read.text(at).select("repo", "cve", F.col("value").alias("func"))


def store_commits(spark, d):
    """The commit list of each repo, written once: a second run changes nothing."""
    log = table(spark, d, "vuln_patch_src_db").where("repo is not null and hsh is not null").groupBy("repo", F.col("hsh").alias("hash")).agg(F.min("src_id").alias("seq"))
    at = scratch(spark, "commits")
    writers.commit_list(log, at)
    writers.commit_list(log.limit(1), at)
    return spark.read.text(at).select("repo", F.col("value").alias("hash"))


def store_mods(spark, d):
    """Scores of modifications as lines."""
    tg, sig, parts = graphs._signatures(spark, d)
    hits = match.hits_eval(parts, table(spark, d, "triples"))
    mods = evaluate.modified_verdicts(evaluate.clone_types(evaluate.line_diff(evaluate.modified(cut(tg, "targets")))), sig, hits)
    at = scratch(spark, "mods")
    writers.modifications(mods, at)
    return spark.read.text(at)


def store_once(spark, d):
    """Scores kept from an earlier run are read, not made again."""
    at = f"{scratch(spark, 'cached')}/scores"
    src = table(spark, d, "part").select("p_partkey", "p_brand")
    writers.once(src, at)
    return writers.once(src.where("false"), at)


def read_labels(spark, d):
    """Manual labels by way of their text file, in its order."""
    rows = table(spark, d, "funcs").where("cve is not null and repo is not null").select("cve", "repo").distinct()
    at = scratch(spark, "labels")
    writers.text(rows.select(F.concat_ws(" ", F.when(F.length("repo") % 2 == 0, "TP").otherwise("FP"), "cve", "repo").alias("value")), at)
    return readers.manual_labels(spark, at).groupBy("verdict", "cve", "path_part").agg((F.min("line_no") > 0).alias("numbered"))


def read_repos(spark, d):
    at = scratch(spark, "repos")
    writers.text(table(spark, d, "funcs").where("repo is not null").select(F.concat(F.lit("  "), "repo", F.lit("\t https://host/"), "repo").alias("value")).distinct(), at)
    return readers.repo_list(spark, at)


def read_log(spark, d):
    """Commits by way of JSON lines."""
    src = table(spark, d, "vuln_patch_src_db").where("hsh is not null").select("repo", F.col("src_id").alias("seq"), F.col("hsh").alias("hash"), F.unix_timestamp("committed_at").alias("author_ts"), F.col("cve").alias("message"), (F.col("src_id") < 0).alias("is_merge"), F.array("hsh").alias("parents"))
    at = scratch(spark, "log")
    src.write.json(at)
    return readers.commit_log(spark, at).select("repo", "seq", "hash", "author_ts", "message", "is_merge", F.size("parents").alias("n_parents"))


def read_diffs(spark, d):
    """Changed files of commits by way of ``<repo>/<hash>.diff`` text."""
    lines = graphs._diffs(spark, d)
    at = scratch(spark, "diffs")
    (lines.groupBy("repo", F.concat("hsh", F.lit(".diff")).alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
     .transform(_as_files, at).select(F.count("*")).collect())
    return history.parse_diffs(readers.diff_lines(spark, at), ["repo", "hash"]).select("repo", "hash", "file", "path", F.size("funcs").alias("n_funcs"))


def _as_files(df, at: str):
    from triloom.session import arrow

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(address(at))
        for b in batches:
            for repo, name, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                system.create_dir(f"{base}/{repo}", recursive=True)
                with system.open_output_stream(f"{base}/{repo}/{name}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([b.column(1)], ["name"])

    return df.transform(arrow, run, "name string")


QUERIES = {f.__name__: f for f in (store_graphs, store_signatures, store_sources, store_names, store_commits, store_mods, store_once, read_labels, read_repos, read_log, read_diffs)}

_ROLE = "string_split(file_id, '/')[-4]"
SQL = {
    "store_graphs": graphs._INGEST + f""", ee as (select * from gk where type1 not in ({graphs._BOUND}) and type2 not in ({graphs._BOUND})), t4 as ({graphs._FOUR.replace('select fn_id', 'select file_id, func')}),
al as (select 'funcs' as kept, file_id from fs union all select 'nodes', file_id from gn union all select 'edges', file_id from gk union all select 'triples', file_id from t4 union all select 'vectors', file_id from (select distinct file_id, func from gn))
select {_ROLE} as role, kept, count(*) as n_rows from al group by all""",
    "store_signatures": "with" + TARGET_SQL + "," + PARTS_SQL + ", vv as (select fn_id, min(vec) as vec from vectors where vec is not null group by fn_id) select sig.sig_id, cve, func, nc as n_cvg, np as n_pvg, nn as n_nvg, len(vec) as n_vec from sig join sz using (sig_id) left join vv on vv.fn_id = v_id",
    "store_sources": "select repo, role, count(*) as n_files, coalesce(sum(length(content)), 0)::bigint as n_chars from vuln_patch_src_db where repo is not null and role is not null group by all",
    "store_names": "with" + TARGET_SQL + " select distinct repo, cve, func from tg where cve is not null and role = 'patch'",
    "store_commits": "select distinct repo, hsh as hash from vuln_patch_src_db where repo is not null and hsh is not null",
    "store_mods": graphs._SC.replace("with", "with recursive", 1) + graphs._MOD + graphs._LCS + ", w as (select md.*, case when exists (select 1 from he join sig using (sig_id) where target_id = md.fn_id and contains(md.path, sig.cve)) then case when contains(path, '/vuln/') or contains(path, '/before/') then 'TP' else 'FP' end when contains(path, '/patch/') or contains(path, '/after/') then 'TN' else 'FN' end as verdict from md) select concat_ws(' ', path, added, " + graphs._CLONE + ", verdict) as value from w join y using (fn_id)",
    "store_once": "select p_partkey, p_brand from part",
    "read_labels": "select distinct case when length(repo) % 2 = 0 then 'TP' else 'FP' end as verdict, cve, repo as path_part, true as numbered from funcs where cve is not null and repo is not null",
    "read_repos": "select distinct repo as name, 'https://host/' || repo as url from funcs where repo is not null",
    "read_log": "select repo, src_id as seq, hsh as hash, epoch(committed_at)::bigint as author_ts, cve as message, false as is_merge, 1 as n_parents from vuln_patch_src_db where hsh is not null",
    "read_diffs": graphs._DIFFS + ", f as (select *, regexp_extract(head, '[a-zA-Z0-9_]*\\.c[pp]*') as file, substr(regexp_extract(head, 'a/[/a-zA-Z0-9_-]*\\.c[pp]*'), 3) as path from h), n as (select repo, hsh, src_id, count(distinct name) as k from (select *, regexp_extract_all(line, '([a-zA-Z0-9_]*)\\(', 1)[-1] as name from l where contains(line, '@@')) where name <> '' group by all) select repo, hsh as hash, file, path, n.k as n_funcs from f join n using (repo, hsh, src_id) where file <> ''",
}
