"""Queries on function graphs, signatures, matches and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triloom.functions import scalars
from triloom.functions.vocab import BOUNDARY_TYPES, VECTOR_DIMS
from triloom.operators import align, dense, evaluate, graphalg, history, ingest, match, matchers, postings, rejects, signature, structure, triples
from triloom.plans.files import LINES_SQL
from triloom.plans.projections import GRAPH_SQL, LABEL_SQL, PARTS_SQL, SCORE_SQL, TARGET_SQL, TOKEN_SQL, VERDICT_SQL, code_graph, labels, token_graph
from triloom.session import cut, table

# --- building blocks


def _targets(spark, d):
    return signature.targets(table(spark, d, "funcs"))


def _signatures(spark, d):
    tg = _targets(spark, d)
    sig = cut(signature.pairs(tg), "signatures")
    parts = cut(signature.accepted(signature.parts(sig, table(spark, d, "triples"))), "parts")
    return tg, sig, parts


def _aligned(spark, d):
    nodes, edges = code_graph(spark, d)
    sig = cut(signature.pairs(_targets(spark, d)), "signatures")
    edges = cut(edges, "edges")
    graded = cut(align.degrees(nodes, edges), "nodes")
    return sig, graded, edges, cut(align.align_nodes(sig, graded), "mapping")


# --- ingest


def ingest_sessionize(spark, d):
    rows = rejects.check_node_lines(table(spark, d, "node_lines")).where("reason is null").select(F.col("nodes_path").alias("file_id"), "line_no", "line_id", "key", "type", "code", "location", "function_id")
    # a line delivered twice counts once
    once = ingest.last_wins(rows, ["file_id", "line_no"], ["line_id"])
    return ingest.sessionize(once, order="line_no").select("file_id", "line_no", "key", "type", "fn_key", "func")


def _parsed(spark, d):
    """Node rows of the parser's files, each line once, and edges from each row to the two after it, whatever they are."""
    rows = rejects.check_node_lines(table(spark, d, "node_lines")).where("reason is null").select(F.col("nodes_path").alias("file_id"), "line_no", "line_id", "key", "type", "code", "location", "function_id")
    rows = cut(ingest.last_wins(rows, ["file_id", "line_no"], ["line_id"]), "rows")
    w = Window.partitionBy("file_id").orderBy("line_no")
    step = rows.select("file_id", F.col("key").alias("src"), F.array(*[F.struct(F.lead("key", k).over(w).alias("dst"), F.lit(r).alias("rel")) for k, r in ((1, "FLOWS_TO"), (2, "REACHES"))]).alias("to"))
    return rows, step.select("file_id", "src", F.inline("to")).where("dst is not null")


def ingest_graphs(spark, d):
    rows, edges = _parsed(spark, d)
    functions, nodes, links = ingest.graphs(rows, edges)
    return triples.tripleize(links, nodes).join(functions.select("fn_id", "file_id", "func"), "fn_id").select("file_id", "func", "a", "rel", "b")


def ingest_vectors(spark, d):
    rows, edges = _parsed(spark, d)
    functions, nodes, links = ingest.graphs(rows, edges)
    vec = triples.vectorize(nodes, links).select("fn_id", F.concat_ws(",", F.col("vec").cast("array<string>")).alias("vec"))
    return functions.join(vec, "fn_id").select("file_id", "func", "location", "vec")


def ingest_counts(spark, d):
    rows, edges = _parsed(spark, d)
    functions, nodes, _ = ingest.graphs(rows, edges)
    own = nodes.join(functions.select("fn_id", "file_id"), "fn_id").select("file_id", F.col("fn_id").alias("fn_key"), F.col("node_id").alias("key"))
    read = rows.groupBy("file_id").agg(F.count_if(F.col("type") == "Function").alias("n_functions"))
    return read.join(ingest.dropped_edges(own, edges), "file_id").select("file_id", "n_functions", "n_edges", "n_kept")


def ingest_named(spark, d):
    # the functions of a repo's fixed files are its list; repos without a vulnerable or a fixed file are left out
    rows, edges = _parsed(spark, d)
    rows = rows.select("*", *[c.alias(n) for n, c in scalars.source_key(F.col("file_id"), 1).items()])
    names = rows.where("type = 'Function' and role = 'patch'").select("repo", F.col("code").alias("func"))
    both = ingest.complete(rows.select("file_id", "repo", "role").distinct(), ["repo"])
    functions, nodes, _ = ingest.graphs(rows.join(both, "repo", "left_semi"), edges, names)
    return functions.join(nodes, "fn_id", "left").groupBy("file_id", "func").agg(F.count("node_id").alias("n_nodes"))


def last_write_wins(spark, d):
    rows = rejects.check_node_lines(table(spark, d, "node_lines")).where("reason is null").select(F.col("nodes_path").alias("file_id"), "key", "line_no", "line_id", "type")
    return ingest.last_wins(rows, ["file_id", "key"], ["line_no", "line_id"]).select("file_id", "key", "line_no", "type")


def edge_endpoint_join(spark, d):
    nodes, edges = code_graph(spark, d)
    e = triples.with_endpoints(edges, nodes).where(~F.col("type1").isin(BOUNDARY_TYPES) & ~F.col("type2").isin(BOUNDARY_TYPES))
    return e.groupBy("type1", "rel", "type2").agg(F.count("*").alias("n_edges"))


def tripleize(spark, d):
    nodes, edges = code_graph(spark, d)
    return triples.tripleize(edges, nodes)


def tripleize_tokens(spark, d):
    # neighbours come from the window that orders a text, so its triples need no join
    _, e = token_graph(spark, d)
    out = e.select("fn_id", F.explode(F.array("type1", "code1")).alias("a"), "rel", F.array("type2", "code2").alias("_r")).select("fn_id", "a", "rel", F.explode("_r").alias("b")).distinct()
    return out.groupBy("fn_id", "rel").agg(F.count("*").alias("n_triples"))


def vector_node_counts(spark, d):
    nodes, _ = code_graph(spark, d)
    return triples.node_counts(nodes).select("fn_id", "type", F.col("n").alias("n_nodes"))


def vector_edge_counts_k2(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fn_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"))
    return triples.edge_counts(lines)


def vectorize(spark, d):
    nodes, edges = code_graph(spark, d)
    return triples.vectorize(nodes, edges).select("fn_id", F.concat_ws(",", F.col("vec").cast("array<string>")).alias("vec"))


def path_fields(spark, d):
    k = scalars.graph_key(F.col("path"))
    rows = table(spark, d, "funcs").where("path is not null").select("fn_id", *[k[c].alias(c) for c in ("repo", "cve", "role", "hsh", "file", "func", "epoch")], scalars.extension(k["file"]).alias("ext"))
    return rows.distinct()


def char_slice(spark, d):
    at = F.split("location", ":")
    start, end = (F.try_element_at(at, F.lit(i)).try_cast("int") for i in (3, 4))
    return table(spark, d, "funcs").where("location is not null and code is not null").select("fn_id", scalars.char_slice(F.col("code"), start % 97, start % 97 + (end - start) % 89).alias("part")).distinct()


# --- signatures


def sig_pairs(spark, d):
    return signature.pairs(_targets(spark, d))


def sig_missing(spark, d):
    return signature.missing(_targets(spark, d))


def sig_parts(spark, d):
    sig = signature.pairs(_targets(spark, d))
    return signature.parts(sig, table(spark, d, "triples"))


def sig_cvg(spark, d):
    return sig_parts(spark, d).where("part = 'cvg'").drop("part")


def sig_pvg(spark, d):
    return sig_parts(spark, d).where("part = 'pvg'").drop("part")


def sig_nvg(spark, d):
    return sig_parts(spark, d).where("part = 'nvg'").drop("part")


def sig_stats(spark, d):
    sig = cut(signature.pairs(_targets(spark, d)), "signatures")
    nodes, _ = code_graph(spark, d)
    return signature.stats(sig, signature.parts(sig, table(spark, d, "triples")), nodes).select("sig_id", "n_cvg", "n_pvg", "n_nvg", "n_v", "n_p", "nodes_v", "nodes_p", "ok")


def sig_reject_empty(spark, d):
    return sig_stats(spark, d).where("not ok").select("sig_id", "n_cvg", "n_pvg", "n_nvg")


# --- scores and hits


def score_exact(spark, d):
    _, _, parts = _signatures(spark, d)
    return dense.score_exact(parts, table(spark, d, "triples"))


def score_file(spark, d):
    tg, sig, parts = _signatures(spark, d)
    # names and paths are put to signatures and targets before these meet, not to their pairs
    return match.named_lines(dense.score_exact(parts, table(spark, d, "triples"), match.score_names(sig), tg))


def hits_scan(spark, d):
    _, _, parts = _signatures(spark, d)
    return match.hits_scan(parts, table(spark, d, "triples"))


def hits_pruned(spark, d):
    # the candidates that the bound on cvg leaves, before any is scored, hold every hit, as found by the bound on pvg
    _, _, parts = _signatures(spark, d)
    rows = table(spark, d, "triples")
    return match.hits_scan(parts, rows, by="pvg").join(postings.candidates(parts, rows, "cvg", match.SCAN_LEAST), ["sig_id", "target_id"])


def hits_eval(spark, d):
    _, _, parts = _signatures(spark, d)
    return match.hits_eval(parts, table(spark, d, "triples"))


def hit_file(spark, d):
    tg, sig, parts = _signatures(spark, d)
    return match.hit_lines(match.hits_scan(parts, table(spark, d, "triples")), sig, tg)


def threshold_grid(spark, d):
    # pairs are counted where they are scored, so none leaves its task
    _, _, parts = _signatures(spark, d)
    return match.grid(postings.cells(parts, table(spark, d, "triples"), 20))


def char_jaccard(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(scalars.char_jaccard(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


def score_fuzzy(spark, d):
    # every signature against every target; pairs without a similar cvg triple score 0 and have no row
    _, _, parts = _signatures(spark, d)
    return dense.score_all(parts, table(spark, d, "triples"))


def hits_fuzzy(spark, d):
    _, _, parts = _signatures(spark, d)
    return dense.score_all(parts, table(spark, d, "triples"), floor=50.0).where(scalars.is_scan_hit(F.col("cvg"), F.col("pvg"), F.col("nvg")))


# --- evaluation


def target_semi(spark, d):
    tg = _targets(spark, d)
    return evaluate.with_signature(tg, signature.pairs(tg)).select("fn_id", "cve", "func")


def target_names(spark, d):
    tg = _targets(spark, d)
    return evaluate.with_name(tg, signature.pairs(tg)).select("fn_id", "func")


def ground_truth_counts(spark, d):
    return evaluate.ground_truth(_targets(spark, d))


def _judged(spark, d):
    tg, sig, parts = _signatures(spark, d)
    tg = cut(tg, "targets")
    return tg, sig, evaluate.verdicts(tg, sig, match.hits_eval(parts, table(spark, d, "triples")), labels(tg))


def verdicts(spark, d):
    return _judged(spark, d)[2].select("target_id", "sig_id", "verdict")


def eval_slices(spark, d):
    c = evaluate.rates(evaluate.confusion(_judged(spark, d)[2]))
    return c.select("slice", "tp", "fp", "tn", "fn", "unk", *[F.round(x, 9).alias(x) for x in c.columns[6:]])


def rate_lines(spark, d):
    return evaluate.rate_lines(evaluate.rates(evaluate.confusion(_judged(spark, d)[2])))


def eval_zero_safe(spark, d):
    """Rates of the modified versions, 0 where a denominator is."""
    counts = eval_test_modified(spark, d).groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v.lower()) for v in evaluate.VERDICTS])
    c = evaluate.rates(counts, zero=True)
    return c.select("tp", "fp", "tn", "fn", *[F.round(x, 9).alias(x) for x in ("p_nominal", "r_nominal", "f1_nominal")])


def unchanged_filter(spark, d):
    return evaluate.modified(_targets(spark, d)).select("fn_id", "role")


def line_diff(spark, d):
    return evaluate.clone_types(evaluate.line_diff(evaluate.modified(_targets(spark, d)))).select("fn_id", "added", "removed", "n_original", "clone_type")


def eval_test_modified(spark, d):
    tg, sig, parts = _signatures(spark, d)
    hits = match.hits_eval(parts, table(spark, d, "triples"))
    return evaluate.modified_verdicts(evaluate.modified(cut(tg, "targets")), sig, hits).groupBy("verdict").agg(F.count("*").alias("n"))


# --- history


def _commits(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def asof_before(spark, d):
    return history.versions_before(_commits(spark, d))


def asof_after(spark, d):
    return history.versions_after(_commits(spark, d))


def first_productive(spark, d):
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("n_files")).where(F.col("n_files").between(1, 5))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("repo"), F.col("o_custkey").alias("cve"))
    return history.first_productive(rows.join(files, "seq"), ["repo", "cve"], ["seq"])


def _diffs(spark, d):
    """Diff text of each commit (repo, hsh): every mined version of it as one changed file, with a hunk for each line that may open a function."""
    src = table(spark, d, "vuln_patch_src_db").where("repo is not null and hsh is not null and content is not null")
    at = F.coalesce("path", "curr_file", F.lit(""))
    body = F.transform(F.split("content", "\r\n|\n|\r"), lambda x, i: F.when(x.rlike(r"^[A-Za-z_].*\("), F.concat(F.lit("@@ -"), i.cast("string"), F.lit(" @@ "), x)).otherwise(F.concat(F.lit("+"), x)))
    head = F.array(F.concat(F.lit("    fix "), F.coalesce("cve", F.lit("it"))), F.concat(F.lit("diff --git a/"), at, F.lit(" b/"), at), F.concat(F.lit("index "), F.substring(F.sha2(at, 256), 1, 7), F.lit(".."), F.substring(F.sha2("content", 256), 1, 7), F.lit(" 100644")))
    lines = src.select("repo", "hsh", "src_id", F.posexplode(F.concat(head, body)).alias("pos", "line"))
    return lines.select("repo", "hsh", F.struct("src_id", "pos").alias("line_no"), "line")


def diff_parse(spark, d):
    lines = _diffs(spark, d)
    kept = history.small_commits(lines, ["repo", "hsh"]).select("repo", "hsh")
    return history.parse_diffs(lines, ["repo", "hsh"]).join(kept, ["repo", "hsh"], "left_semi").withColumn("funcs", F.array_join("funcs", ","))


def diff_versions(spark, d):
    # the blobs are the mined texts, named by their digests
    lines = _diffs(spark, d)
    texts = table(spark, d, "vuln_patch_src_db").where("content is not null").select(F.sha2("content", 256).alias("blob_id"), "content").distinct()
    found = history.with_versions(history.parse_diffs(lines, ["repo", "hsh"]), texts, ["repo", "hsh"])
    return found.select("repo", "hsh", "file", "path", "role", F.length("content").alias("n_chars"))


def cve_commits(spark, d):
    log = table(spark, d, "vuln_patch_src_db").select("src_id", (F.coalesce("role", F.lit("")) == "before").alias("is_merge"), F.concat(F.lit("see "), F.coalesce("cve", F.lit("nothing")), F.lit(" in "), F.coalesce("path", F.lit("-"))).alias("message"))
    return history.cve_commits(log).select("src_id", "cve")


def new_commits(spark, d):
    # versions whose commit has no function graph yet
    mined = table(spark, d, "vuln_patch_src_db").select("repo", "hsh").dropna().distinct()
    return history.not_known(mined, table(spark, d, "funcs").select("repo", "hsh"), ["repo", "hsh"])


def mined_commits(spark, d):
    return history.mined(_diffs(spark, d), ["repo", "hsh"])


def mine_counters(spark, d):
    return history.counters(mined_commits(spark, d), ["repo"])


def after_ancestry(spark, d):
    # orders are commits of five repos, in order of time; some start from the last but one, some merge two lines
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("repo"), F.col("o_orderkey").alias("seq"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("c_nationkey").cast("string").alias("path"), "o_orderstatus")
    w = Window.partitionBy("repo").orderBy("ts", "seq")
    back = lambda k: F.lag(F.col("seq").cast("string"), k).over(w)
    parents = F.array_compact(F.array(F.when(F.col("seq") % 5 == 0, back(2)).otherwise(back(1)), F.when(F.col("seq") % 11 == 0, back(3))))
    commits = cut(o.select("repo", "seq", F.col("seq").cast("string").alias("hash"), "ts", "path", F.array("path").alias("paths"), parents.alias("parents"), "o_orderstatus"), "commits")
    return history.versions_along(commits, commits.where("o_orderstatus = 'P'"))


# --- graphs


def align_nodes(spark, d):
    return _aligned(spark, d)[3]


def changed_nodes(spark, d):
    sig, nodes, _, mapping = _aligned(spark, d)
    return align.changed_nodes(sig, nodes, mapping).select("sig_id", "side", "node_id")


def induced_edges(spark, d):
    sig, nodes, edges, mapping = _aligned(spark, d)
    return align.induced_edges(align.changed_nodes(sig, nodes, mapping), edges, ["sig_id", "side"]).select("sig_id", "side", "src", "dst", "rel")


def context_nodes(spark, d):
    sig, nodes, edges, mapping = _aligned(spark, d)
    return align.context_nodes(sig, mapping, cut(align.changed_nodes(sig, nodes, mapping), "changed"), edges)


def expand_1hop(spark, d):
    sig, nodes, edges, mapping = _aligned(spark, d)
    return align.expand(align.changed_nodes(sig, nodes, mapping), edges, ["sig_id", "side"]).select("sig_id", "side", "node_id")


def two_hop(spark, d):
    return align.two_hop(code_graph(spark, d)[1])


def _trade(spark, d):
    # suppliers and parts as one bipartite graph
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


def components(spark, d):
    tg = _targets(spark, d)
    links = tg.where("cve is not null").select("fn_id", F.concat(F.lit("c:"), "repo", F.lit("/"), "cve").alias("x"))
    return graphalg.connected_components(links.unionByName(tg.select("fn_id", F.concat(F.lit("h:"), "hsh").alias("x"))), "fn_id", "x")


def bfs_tree(spark, d):
    e = _trade(spark, d)
    return graphalg.bfs_tree(e, e.agg(F.min("src").alias("node")))


def subtree_size(spark, d):
    return graphalg.subtree_sizes(bfs_tree(spark, d)).select("node", "size")


def nh_index(spark, d):
    nodes, edges = code_graph(spark, d)
    return structure.neighbourhood_index(nodes, structure.simple(edges)).withColumn("labels", F.array_join("labels", ","))


def important_nodes(spark, d):
    nodes, edges = code_graph(spark, d)
    return structure.important_nodes(structure.neighbourhood_index(nodes, structure.simple(edges))).select("fn_id", "node_id", "degree")


def tale_node_score(spark, d):
    nodes, edges = code_graph(spark, d)
    index = cut(structure.neighbourhood_index(nodes, structure.simple(edges)), "index")
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    s = structure.node_pairs(pairs, index).withColumn("score", structure.tolerant_score()).where("score > 0")
    return s.groupBy("q_fn", "t_fn").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 6).alias("total"))


def path_node_match(spark, d):
    nodes, edges = code_graph(spark, d)
    index = cut(structure.direction_index(nodes, structure.simple(edges)), "index")
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    return structure.node_pairs(pairs, index).where(structure.dominates()).groupBy("q_fn", "t_fn").agg(F.count("*").alias("n_pairs"))


def path_node_score(spark, d):
    nodes, edges = code_graph(spark, d)
    index = cut(structure.direction_index(nodes, structure.simple(edges)), "index")
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    s = structure.node_pairs(pairs, index).withColumn("score", structure.cover_score(r=0.5)).where("score > 0")
    return s.groupBy("q_fn", "t_fn").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 6).alias("total"))


def assignment(spark, d):
    """The largest total weight of an assignment of each query's important nodes to target nodes."""
    nodes, edges = code_graph(spark, d)
    index = cut(structure.neighbourhood_index(nodes, structure.simple(edges)), "index")
    best = structure.important_nodes(index).select(F.col("fn_id").alias("q_fn"), F.col("node_id").alias("q_node"))
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    scored = structure.node_pairs(pairs, index).join(best, ["q_fn", "q_node"], "left_semi").select("q_fn", "t_fn", F.col("q_node").alias("a"), F.col("t_node").alias("b"), structure.tolerant_score().alias("w")).where("w > 0")
    found = matchers.assigned(scored)
    return found.groupBy("q_fn", "t_fn").agg(F.round(F.sum("w"), 6).alias("total"), (F.count_distinct("a") == F.count("*")).alias("one"), (F.count_distinct("b") == F.count("*")).alias("each"))


def connect_checks(spark, d):
    """For each side of a signature whether the connected set is one component and holds what it was made of."""
    sig, nodes, edges, mapping = _aligned(spark, d)
    changed = cut(align.changed_nodes(sig, nodes, mapping), "changed")
    grown = cut(matchers.connected(changed, matchers.packed(nodes, edges)), "connected")
    name = lambda c: F.concat_ws(" ", "sig_id", "side", c)
    links = align.induced_edges(grown, edges, ["sig_id", "side"]).select(name("src").alias("src"), name("dst").alias("dst"))
    parts = graphalg.connected_components(links.unionByName(grown.select(name("node_id").alias("src"), name("node_id").alias("dst"))))
    per = grown.select("sig_id", "side", name("node_id").alias("node")).join(parts, "node").groupBy("sig_id", "side").agg((F.count_distinct("component") == 1).alias("one"))
    lost = changed.join(grown, ["sig_id", "side", "fn_id", "node_id"], "left_anti").select("sig_id", "side", F.lit(True).alias("lost")).distinct()
    return per.join(lost, ["sig_id", "side"], "left").select("sig_id", "side", "one", F.col("lost").isNull().alias("whole"))


def edge_pattern_iso(spark, d):
    nodes, edges = code_graph(spark, d)
    return structure.edge_pattern(nodes, edges, [("a", "FLOWS_TO", "b"), ("b", "FLOWS_TO", "c"), ("a", "REACHES", "c")], {"a": "Callee", "b": "ArgumentList", "c": "ExpressionStatement"})


def _matched(spark, d, how):
    nodes, edges = code_graph(spark, d)
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    graphs = cut(matchers.packed(nodes, edges), "graphs")
    return matchers.match(pairs, graphs, how).select("q_fn", "t_fn", F.round("score", 9).alias("score"), F.size("mapping").alias("n_mapped"))


def exact_match(spark, d):
    return _matched(spark, d, "exact")


def tale_match(spark, d):
    return _matched(spark, d, "tolerant")


def path_match(spark, d):
    return _matched(spark, d, "path")


def match_checks(spark, d):
    """For each matcher the pairs, and those whose mapping or score can't be: other types, nodes that aren't there, a score that isn't that of the mapping."""
    nodes, edges = code_graph(spark, d)
    pairs = signature.pairs(_targets(spark, d)).select(F.col("v_id").alias("q_fn"), F.col("p_id").alias("t_fn"))
    graphs, nodes = cut(matchers.packed(nodes, edges), "graphs"), cut(nodes, "nodes")
    size = nodes.groupBy(F.col("fn_id").alias("q_fn")).agg(F.count("*").alias("n"))
    kind = lambda fn, at, name: nodes.select(F.col("fn_id").alias(fn), F.col("node_id").alias(at), F.col("type").alias(name))
    out = None
    for how in ("tolerant", "path"):
        found = cut(matchers.match(pairs, graphs, how), "matched").join(size, "q_fn")
        each = found.select("q_fn", "t_fn", F.explode("mapping").alias("a", "m")).select("q_fn", "t_fn", "a", F.col("m.t").alias("b"), F.col("m.score").alias("s"))
        odd = each.join(kind("q_fn", "a", "qt"), ["q_fn", "a"], "left").join(kind("t_fn", "b", "tt"), ["t_fn", "b"], "left").groupBy("q_fn", "t_fn").agg(F.count_if(~(F.col("qt") == F.col("tt")) | F.col("qt").isNull() | F.col("tt").isNull()).alias("odd"), F.count_distinct("b").alias("images"), F.count("*").alias("k"), F.sum("s").alias("total"))
        all_ = found.join(odd, ["q_fn", "t_fn"], "left").fillna(0)
        most = F.col("n") * (2.0 if how == "tolerant" else 1.0)
        bad = (F.col("odd") > 0) | (F.abs(F.col("score") - F.col("total") / most) > 1e-9) | (F.col("score") > 1 + 1e-9) | ((F.lit(how) == "path") & (F.col("images") < F.col("k")))
        row = all_.agg(F.lit(how).alias("how"), F.count("*").alias("n_pairs"), F.count_if(bad).alias("n_wrong"))
        out = row if out is None else out.unionByName(row)
    return out


def aligned_checks(spark, d):
    """For each signature whether its node sets can be: positive and negative hold all that changed, as many nodes as they must, and no context of either."""
    sig, nodes, edges, mapping = _aligned(spark, d)
    changed = cut(align.changed_nodes(sig, nodes, mapping), "changed")
    sets = cut(matchers.aligned_signature(sig, changed, mapping, matchers.packed(nodes, edges)), "sets")
    own = lambda s: changed.where(F.col("side") == s).groupBy("sig_id").agg(F.collect_set("node_id").alias(f"{s}_only"))
    rows = sets.join(sig.select("sig_id", "v_id", "p_id"), "sig_id").join(own("v"), "sig_id", "left").join(own("p"), "sig_id", "left")
    for s in ("v", "p"):
        rows = rows.join(nodes.groupBy(F.col("fn_id").alias(f"{s}_id")).agg(F.count("*").alias(f"n_{s}")), f"{s}_id")
    held = lambda s, name: F.when(F.col(f"{s}_only").isNull(), F.size(name) == 0).otherwise((F.size(F.array_except(f"{s}_only", name)) == 0) & (F.size(name) >= F.least(F.lit(50), f"n_{s}")))
    return rows.select("sig_id", held("v", "positive").alias("positive"), held("p", "negative").alias("negative"))


def aligned_signature(spark, d):
    sig, nodes, edges, mapping = _aligned(spark, d)
    out = matchers.aligned_signature(sig, align.changed_nodes(sig, nodes, mapping), mapping, matchers.packed(nodes, edges))
    return out.select("sig_id", *[F.size(c).alias(f"n_{c}") for c in ("positive", "negative", "context")])


QUERIES = {
    f.__name__: f
    for f in (
        ingest_sessionize, ingest_graphs, ingest_vectors, ingest_counts, ingest_named, last_write_wins, edge_endpoint_join, tripleize, tripleize_tokens, vector_node_counts, vector_edge_counts_k2, vectorize, path_fields, char_slice,
        sig_pairs, sig_missing, sig_parts, sig_cvg, sig_pvg, sig_nvg, sig_stats, sig_reject_empty, score_exact, score_file, hits_scan, hits_pruned, hits_eval, hit_file, threshold_grid, char_jaccard, score_fuzzy, hits_fuzzy,
        target_semi, target_names, ground_truth_counts, verdicts, eval_slices, rate_lines, eval_zero_safe, unchanged_filter, line_diff, eval_test_modified, asof_before, asof_after, after_ancestry, first_productive, diff_parse, diff_versions, cve_commits, new_commits, mined_commits, mine_counters,
        align_nodes, changed_nodes, induced_edges, context_nodes, expand_1hop, two_hop, components, bfs_tree, subtree_size, nh_index, important_nodes, tale_node_score, path_node_match, path_node_score, assignment, connect_checks, edge_pattern_iso, exact_match, tale_match, path_match, match_checks, aligned_signature, aligned_checks,
    )
}

# --- SQL

_G, _TG, _PT, _SC = "with" + GRAPH_SQL, "with" + TARGET_SQL, "with" + TARGET_SQL + "," + PARTS_SQL, "with" + TARGET_SQL + "," + PARTS_SQL + "," + SCORE_SQL
_BOUND = ", ".join(f"'{t}'" for t in BOUNDARY_TYPES)
_DIMS = ", ".join(f"'{t}'" for t in VECTOR_DIMS)
_ENDS = f"""select e.fn_id, a.type as type1, a.code as code1, rel, b.type as type2, b.code as code2 from ge e join gn a on a.fn_id = e.fn_id and a.node_id = src join gn b on b.fn_id = e.fn_id and b.node_id = dst where a.type not in ({_BOUND}) and b.type not in ({_BOUND})"""
_FOUR = "select fn_id, type1 as a, rel, type2 as b from ee union select fn_id, code1, rel, type2 from ee where code1 <> '' union select fn_id, type1, rel, code2 from ee where code2 <> '' union select fn_id, code1, rel, code2 from ee where code1 <> '' and code2 <> ''"
_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
_SIM = "case when {0} = {1} then 1.0::double else len(list_intersect({2}, {3}))::double / (len({2}) + len({3}) - len(list_intersect({2}, {3}))) end"


def _jaccard(a: str, b: str) -> str:
    return _SIM.format(a, b, _CHARS.format(a), _CHARS.format(b))


_ALIGN = f"""with{GRAPH_SQL},{TARGET_SQL},
dg as (select gs.*, coalesce(i, 0) as in_deg, coalesce(o, 0) as out_deg from gs left join (select fn_id, node_id, sum(i) as i, sum(o) as o from (select fn_id, src as node_id, 0 as i, 1 as o from ge union all select fn_id, dst, 1, 0 from ge) group by all) using (fn_id, node_id)),
vn as (select sig_id, dg.* from sig join dg on fn_id = v_id), pn as (select sig_id, dg.* from sig join dg on fn_id = p_id),
sk as (select sig_id, vn.node_id as v_node, h.node_id as p_node from vn join (select sig_id, type, arg_min(node_id, seq) as node_id from pn where type in ('CFGEntryNode', 'CFGExitNode', 'FunctionDef') group by sig_id, type) h using (sig_id, type)),
vk as (select *, row_number() over (partition by sig_id, code, type, in_deg, out_deg order by seq) as k from vn where (sig_id, node_id) not in (select sig_id, v_node from sk)),
pk as (select *, row_number() over (partition by sig_id, code, type, in_deg, out_deg order by seq) as k from pn where (sig_id, node_id) not in (select sig_id, p_node from sk)),
mp as (select * from sk union all select vk.sig_id, vk.node_id, pk.node_id from vk join pk using (sig_id, code, type, in_deg, out_deg, k)),
ch as (select sig_id, 'v' as side, fn_id, node_id from vn where (sig_id, node_id) not in (select sig_id, v_node from mp) union all select sig_id, 'p', fn_id, node_id from pn where (sig_id, node_id) not in (select sig_id, p_node from mp)),
nb as (select fn_id, src as x, dst as y from ge union select fn_id, dst, src from ge)
"""
_TRADE = "with recursive e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), u as (select a, b from e union select b, a from e), t as (select min(a) as node, 0 as depth from e union select u.b, depth + 1 from t join u on u.a = t.node where depth < 8), dp as (select node, min(depth) as depth from t group by node), tree as (select (select min(a) from e) as root, dp.node, case when dp.depth > 0 then min(q.node) end as parent, dp.depth from dp left join u on u.b = dp.node left join dp q on q.node = u.a and q.depth = dp.depth - 1 group by dp.node, dp.depth)"
_INDEX = f"""with{GRAPH_SQL},
dgr as (select fn_id, node_id, count(*) as degree from (select fn_id, src as node_id from g1 union all select fn_id, dst from g1) group by all),
lab as (select g1.fn_id, src as node_id, list_sort(list(distinct type)) as labels from g1 join gn on gn.fn_id = g1.fn_id and gn.node_id = dst group by all),
lnk as (select x.fn_id, x.src as node_id, count(*) as n from g1 x join g1 y on y.fn_id = x.fn_id and y.src = x.dst join g1 z on z.fn_id = x.fn_id and z.src = x.src and z.dst = y.dst group by all),
ix as (select gn.fn_id, gn.node_id, type as label, coalesce(degree, 0) as degree, coalesce(labels, []) as labels, coalesce(n, 0) // 2 as links from gn left join dgr using (fn_id, node_id) left join lab using (fn_id, node_id) left join lnk using (fn_id, node_id))"""
_TALE = _INDEX + "," + TARGET_SQL + """, pr as (select v_id as q_fn, p_id as t_fn, q.degree as qd, t.degree as td, q.links as ql, t.links as tl, len(q.labels) - len(list_intersect(q.labels, t.labels)) as miss, floor(q.degree * 0.1)::bigint as may, q.node_id as a, t.node_id as b from sig join ix q on q.fn_id = v_id join ix t on t.fn_id = p_id and t.label = q.label),
w as (select *, may * floor((may - 1) / 2.0)::bigint + (qd - may) * may as lmay, case when ql = 0 then 0.0::double else greatest(0, ql - tl)::double / ql end as fl from pr),
x as (select q_fn, t_fn, a, b, case when miss = 0 then 2.0::double - fl else 2.0::double - (miss::double / nullif(qd, 0) + fl / miss) end as score from w where td >= qd - may and miss <= may and tl >= ql - lmay)"""
_COMMITS = "with c as (select o_custkey as path, epoch(o_orderdate)::bigint as ts, o_orderkey as seq from orders)"
_DIFFS = r"""with s as (select repo, hsh, src_id, content, regexp_extract(cve, 'CVE-[0-9]*-[0-9]*') as c, coalesce(path, curr_file, '') as p from vuln_patch_src_db where repo is not null and hsh is not null and content is not null),
h as (select repo, hsh, src_id, nullif(c, '') as cve, 'diff --git a/' || p || ' b/' || p as head, substr(sha256(p), 1, 7) as old_id, substr(sha256(content), 1, 7) as new_id, row_number() over (partition by repo, hsh order by src_id) as k, count(*) over (partition by repo, hsh) as all_files from s),
l as (select repo, hsh, src_id, case when regexp_matches(x, '^[A-Za-z_].*\(') then '@@ ' || x else '+' || x end as line from (select repo, hsh, src_id, unnest(string_split_regex(content, '\r\n|\n|\r')) as x from s))"""
_ANCESTRY = """with recursive c as (select o_orderpriority as repo, o_orderkey as hash, epoch(o_orderdate)::bigint as ts, c_nationkey as path, o_orderstatus as st from orders join customer on c_custkey = o_custkey),
k as (select repo, hash, lag(hash) over w as p1, lag(hash, 2) over w as p2, lag(hash, 3) over w as p3 from c window w as (partition by repo order by ts, hash)),
e as (select hash as child, case when hash % 5 = 0 then p2 else p1 end as parent from k union select hash, p3 from k where hash % 11 = 0),
r1 as (select hash as root, hash from c where st = 'P' union select root, child from r1 join e on parent = hash),
d1 as (select x.hash as root, x.ts as t0, y.ts, y.hash from r1 join c x on x.hash = root join c y on y.hash = r1.hash where y.path = x.path and y.hash <> x.hash),
a1 as (select root, arg_min(hash, (ts, hash)) as a, arg_max(hash, (ts, hash)) filter (where ts <= t0 + 2592000) as m, arg_max(hash, (ts, hash)) filter (where ts <= t0 + 15552000) as h from d1 group by root),
r2 as (select m as root, m as hash from a1 where m is not null union select h, h from a1 where h is not null union select root, child from r2 join e on parent = hash),
n2 as (select root, arg_min(y.hash, (y.ts, y.hash)) as nx from r2 join c x on x.hash = root join c y on y.hash = r2.hash where y.path = x.path and y.hash <> x.hash group by root),
b1 as (select a1.root, a, h, case when m is null then (select arg_min(hash, (ts, hash)) from d1 where d1.root = a1.root and hash <> a) else (select nx from n2 where n2.root = m) end as b from a1),
c1 as (select root, a, b, case when b is null then null when h is null then (select arg_min(hash, (ts, hash)) from d1 where d1.root = b1.root and hash not in (a, b)) else (select nx from n2 where n2.root = h) end as s from b1)
select c.repo, c.path::varchar as path, c.hash::varchar as hash, a::varchar as after, b::varchar as after_1mo, s::varchar as after_6mo from c left join c1 on root = c.hash where st = 'P'"""
_VERDICT = f"{_SC},{LABEL_SQL},{VERDICT_SQL}"
_MOD = """,
m0 as (select *, case when role in ('vuln', 'before') then 'v' else 'p' end as kind from tg where code is not null),
mo as (select repo, cve, func, kind, arg_max(code, (hsh, fn_id)) as original from m0 where role in ('vuln', 'patch') group by all),
md as (select n.fn_id, n.role, n.path, n.cve, n.code, original from m0 n join mo using (repo, cve, func, kind) where role in ('before', 'after') and not exists (select 1 from m0 o where o.role in ('vuln', 'patch') and o.repo = n.repo and o.cve = n.cve and o.func = n.func and o.kind = n.kind and o.code = n.code))
"""
_RATES = ", ".join(
    f"round({p}, 9) as p_{n}, round({r}, 9) as r_{n}, round(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 9) as f1_{n}"
    for n, h, w in (("nominal", "tp", "fp"), ("worst", "tp", "fp + unk"), ("best", "tp + unk", "fp"))
    for p, r in [(f"({h})::double / nullif({h} + {w}, 0)", f"({h})::double / nullif({h} + fn, 0)")]
)
# each side of a pair of triples must be above 0.4 for the mean to be above 0.7
_FUZZY = f"""{_PT}, xs as (select a as x from ap union select b from ap), ys as (select a as y from tr union select b from tr),
xc as (select x, {_CHARS.format('x')} as cx from xs), yc as (select y, {_CHARS.format('y')} as cy from ys),
ss as (select * from (select x, y, {_SIM.format('x', 'y', 'cx', 'cy')} as s from xc cross join yc) where s > 0.4),
lt as (select distinct a, rel, b from ap), rt as (select distinct a, rel, b from tr),
lm as (select l.a, l.rel, l.b, r.a as ta, r.b as tb, (sa.s + sb.s) / 2 as s from lt l join ss sa on sa.x = l.a join rt r on r.rel = l.rel and r.a = sa.y join ss sb on sb.x = l.b and sb.y = r.b where (sa.s + sb.s) / 2 > 0.7),
lb as (select fn_id as target_id, lm.a, lm.rel, lm.b, max(s) as best from lm join tr on tr.a = ta and tr.rel = lm.rel and tr.b = tb group by all),
t as (select sig_id, target_id, sum(best) filter (where part = 'cvg') as c, sum(best) filter (where part = 'pvg') as p, sum(best) filter (where part = 'nvg') as n from ap join lb on lb.a = ap.a and lb.rel = ap.rel and lb.b = ap.b group by sig_id, target_id),
f0 as (select sig_id, target_id, round(100.0::double * c / nc, 9) as cvg, 100.0::double * coalesce(p, 0) / np as p, 100.0::double * coalesce(n, 0) / nn as n from t join sz using (sig_id) where c > 0),
fz as (select sig_id, target_id, cvg, case when cvg > 50 then round(p, 9) else 0 end as pvg, case when cvg > 50 then round(n, 9) else 0 end as nvg from f0)"""
_LCS = """, x as (select fn_id, string_split(regexp_replace(original, '\\n$', ''), chr(10)) as a, string_split(regexp_replace(code, '\\n$', ''), chr(10)) as b, length(original) - length(replace(original, chr(10), '')) as n from md),
lcs as (select fn_id, 0 as i, list_transform(range(0, len(b) + 1), lambda j: 0) as prev from x
  union all select x.fn_id, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::int]), lambda acc, j: list_append(acc, case when a[i + 1] = b[j[1]] then prev[j[1]] + 1 else greatest(prev[j[1] + 1], acc[-1]) end), [0]) from lcs join x on x.fn_id = lcs.fn_id where i < len(a)),
y as (select x.fn_id, len(b) - prev[-1] as added, len(a) - prev[-1] as removed, n from x join lcs on lcs.fn_id = x.fn_id and i = len(a))"""
_CLONE = "case when added = removed then 2 when added + removed > floor(n * 0.5) then 4 else 3 end"
_SLICES = ", s as (select 'all' as slice, verdict from vr union all select 'train', verdict from vr where contains(path, '/vuln/') or contains(path, '/patch/') union all select 'test', verdict from vr where contains(path, '/before/') or contains(path, '/after/')), k as (select slice, count(*) filter (where verdict = 'TP') as tp, count(*) filter (where verdict = 'FP') as fp, count(*) filter (where verdict = 'TN') as tn, count(*) filter (where verdict = 'FN') as fn, count(*) filter (where verdict = 'UNK') as unk from s group by slice)"
_CHANGED = ", w as (select case when exists (select 1 from he join sig using (sig_id) where target_id = md.fn_id and contains(md.path, sig.cve)) then case when contains(path, '/vuln/') or contains(path, '/before/') then 'TP' else 'FP' end when contains(path, '/patch/') or contains(path, '/after/') then 'TN' else 'FN' end as verdict from md)"
_DIRECTED = f"""with{GRAPH_SQL},{TARGET_SQL},
oi as (select g1.fn_id, src as node_id, count(*) as d, list(distinct type) as l, list(distinct rel) as r from g1 join gn on gn.fn_id = g1.fn_id and gn.node_id = dst group by all),
ii as (select g1.fn_id, dst as node_id, count(*) as d, list(distinct type) as l, list(distinct rel) as r from g1 join gn on gn.fn_id = g1.fn_id and gn.node_id = src group by all),
ix as (select gn.fn_id, gn.node_id, type as label, coalesce(ii.d, 0) as ind, coalesce(oi.d, 0) as outd, coalesce(ii.l, []) as il, coalesce(oi.l, []) as ol, coalesce(ii.r, []) as ir, coalesce(oi.r, []) as outr from gn left join ii using (fn_id, node_id) left join oi using (fn_id, node_id))"""
_NODE_ROWS = LINES_SQL + ", w as (select u.nodes_path as file_id, line_no, u.line_id, c[2] as key, c[3] as type, c[4] as code from u join v on v.line_id = u.line_id join node_lines n on n.line_id = u.line_id where ok)"


_INGEST = _NODE_ROWS + """, x as (select file_id, line_no, arg_max(key, line_id) as key, arg_max(type, line_id) as type, arg_max(code, line_id) as code, arg_max(loc, line_id) as loc from (select w.*, u.c[5] as loc from w join u on u.line_id = w.line_id) group by file_id, line_no),
y as (select *, max(case when type = 'Function' then line_no end) over (partition by file_id order by line_no) as s from x),
fs as (select file_id, code as func, max(line_no) as s, arg_max(loc, line_no) as location from x where type = 'Function' group by all),
gn as (select y.file_id, func, key, arg_max(type, line_no) as type, arg_max(code, line_no) as code from y join fs on fs.file_id = y.file_id and fs.s = y.s where type <> 'Function' group by all),
ld as (select file_id, key as src, lead(key) over w as n1, lead(key, 2) over w as n2 from x window w as (partition by file_id order by line_no)),
eg as (select file_id, src, n1 as dst, 'FLOWS_TO' as rel from ld where n1 is not null union all select file_id, src, n2, 'REACHES' from ld where n2 is not null),
gk as (select eg.file_id, a.func, src, dst, rel, a.type as type1, a.code as code1, b.type as type2, b.code as code2 from eg join gn a on a.file_id = eg.file_id and a.key = src join gn b on b.file_id = eg.file_id and b.func = a.func and b.key = dst)"""
_KEYED = "string_split(file_id, '/')"


SQL = {
    "ingest_graphs": _INGEST + f", ee as (select * from gk where type1 not in ({_BOUND}) and type2 not in ({_BOUND})) " + _FOUR.replace("select fn_id", "select file_id, func"),
    "ingest_vectors": _INGEST + f", dims as (select unnest([{_DIMS}]) as dim, unnest(range(0, 79)) as pos), par as (select file_id, func, src, dst, count(*) as k from gk group by all), cnt as (select file_id, func, type as dim, count(*) as n from gn group by all union all select gk.file_id, gk.func, rel, sum(k) from gk join par using (file_id, func, src, dst) group by all), hold as (select distinct fs.* from fs join gn using (file_id, func)) select hold.file_id, hold.func, hold.location, array_to_string(list(coalesce(n, 0)::bigint order by pos), ',') as vec from hold cross join dims left join cnt on cnt.file_id = hold.file_id and cnt.func = hold.func and cnt.dim = dims.dim group by all",
    "ingest_counts": _INGEST + " select x.file_id, n_functions, n_edges, coalesce(n_kept, 0) as n_kept from (select file_id, count(*) filter (where type = 'Function') as n_functions from x group by file_id) x join (select file_id, count(*) as n_edges from eg group by file_id) e using (file_id) left join (select file_id, count(*) as n_kept from gk group by file_id) k using (file_id)",
    "ingest_named": _INGEST + f", fr as (select *, {_KEYED}[-6] as repo, {_KEYED}[-4] as role from fs), pk as (select distinct repo, func from fr where role = 'patch'), bo as (select repo from (select {_KEYED}[-6] as repo, {_KEYED}[-4] as role from x) group by repo having count(*) filter (where role = 'vuln') > 0 and count(*) filter (where role = 'patch') > 0) select fr.file_id, fr.func, count(key) as n_nodes from fr join pk using (repo, func) join bo using (repo) left join gn on gn.file_id = fr.file_id and gn.func = fr.func group by all",
    "ingest_sessionize": _NODE_ROWS + ", x as (select file_id, line_no, arg_max(key, line_id) as key, arg_max(type, line_id) as type, arg_max(code, line_id) as code from w group by file_id, line_no), y as (select *, max(case when type = 'Function' then line_no end) over (partition by file_id order by line_no) as s from x) select y.file_id, y.line_no, y.key, y.type, f.key as fn_key, f.code as func from y join x f on f.file_id = y.file_id and f.line_no = s where y.type <> 'Function'",
    "last_write_wins": _NODE_ROWS + " select file_id, key, (max((line_no, line_id)))[1] as line_no, arg_max(type, (line_no, line_id)) as type from w group by file_id, key",
    "edge_endpoint_join": f"{_G}, ee as ({_ENDS}) select type1, rel, type2, count(*) as n_edges from ee group by all",
    "tripleize": f"{_G}, ee as ({_ENDS}) {_FOUR}",
    "tripleize_tokens": f"with{TOKEN_SQL}, t as (select fn_id, type1 as a, rel, type2 as b from te union select fn_id, code1, rel, type2 from te union select fn_id, type1, rel, code2 from te union select fn_id, code1, rel, code2 from te) select fn_id, rel, count(*) as n_triples from t group by all",
    "vector_node_counts": f"{_G} select fn_id, type, count(*) as n_nodes from gn group by all",
    "vector_edge_counts_k2": "with p as (select l_suppkey as fn_id, l_orderkey as src, l_partkey as dst, count(*) as k from lineitem group by all) select fn_id, l_returnflag as rel, sum(k)::bigint as n from lineitem join p on l_suppkey = fn_id and l_orderkey = src and l_partkey = dst group by all",
    "vectorize": f"{_G}, dims as (select unnest([{_DIMS}]) as dim, unnest(range(0, 79)) as pos), par as (select fn_id, src, dst, count(*) as k from ge group by all), cnt as (select fn_id, type as dim, count(*) as n from gn group by all union all select ge.fn_id, rel, sum(k) from ge join par using (fn_id, src, dst) group by all) select f.fn_id, array_to_string(list(coalesce(n, 0)::bigint order by pos), ',') as vec from (select distinct fn_id from gn) f cross join dims left join cnt on cnt.fn_id = f.fn_id and cnt.dim = dims.dim group by f.fn_id",
    "path_fields": _TG.replace(", row_number() over (partition by fn_id order by loaded_at desc nulls last, path desc, code desc nulls last) as r", ", 1 as r").replace("fn_id is not null and path", "path") + " select distinct fn_id, repo, cve, role, hsh, file, func, epoch, regexp_extract(file, '[^.]*$') as ext from tg",
    "char_slice": "select distinct fn_id, substring(code, s % 97 + 1, (e - s) % 89 + 1) as part from (select fn_id, code, try_cast(string_split(location, ':')[3] as int) as s, try_cast(string_split(location, ':')[4] as int) as e from funcs where location is not null and code is not null)",
    "sig_pairs": _TG + " select * from sig",
    "sig_missing": _TG + " select fn_id, repo, cve, hsh, file, func, 'no patch graph' as reason from tg where role = 'vuln' and (repo, cve, hsh, file, func) not in (select repo, cve, hsh, file, func from sp)",
    "sig_parts": _PT + " select sig_id, part, a, rel, b from pt",
    "sig_cvg": _PT + " select sig_id, a, rel, b from pt where part = 'cvg'",
    "sig_pvg": _PT + " select sig_id, a, rel, b from pt where part = 'pvg'",
    "sig_nvg": _PT + " select sig_id, a, rel, b from pt where part = 'nvg'",
    "sig_stats": f"{_PT},{GRAPH_SQL}, c as (select sig_id, count(*) filter (where part = 'cvg') as c, count(*) filter (where part = 'pvg') as p, count(*) filter (where part = 'nvg') as n from pt group by sig_id), k as (select fn_id, count(*) as k from gn group by fn_id) select sig.sig_id, coalesce(c, 0) as n_cvg, coalesce(p, 0) as n_pvg, coalesce(n, 0) as n_nvg, coalesce(c + p, 0) as n_v, coalesce(c + n, 0) as n_p, coalesce(kv.k, 0) as nodes_v, coalesce(kp.k, 0) as nodes_p, coalesce(c > 0 and p > 0 and n > 0, false) as ok from sig left join c on c.sig_id = sig.sig_id left join k kv on kv.fn_id = v_id left join k kp on kp.fn_id = p_id",
    "sig_reject_empty": f"{_PT}, c as (select sig_id, count(*) filter (where part = 'cvg') as c, count(*) filter (where part = 'pvg') as p, count(*) filter (where part = 'nvg') as n from pt group by sig_id) select sig.sig_id, coalesce(c, 0) as n_cvg, coalesce(p, 0) as n_pvg, coalesce(n, 0) as n_nvg from sig left join c on c.sig_id = sig.sig_id where not coalesce(c > 0 and p > 0 and n > 0, false)",
    "score_exact": _SC + " select * from sc",
    "score_file": _SC + " select concat_ws(' ', concat_ws('/', sig.repo, sig.cve, sig.hsh, sig.file, sig.func), tg.path, trunc(cvg)::int, trunc(pvg)::int, trunc(nvg)::int) as value from sc join sig using (sig_id) join tg on tg.fn_id = target_id",
    "hits_scan": _SC + " select * from hs",
    "hits_pruned": _SC + " select * from hs",
    "hits_eval": _SC + " select * from he",
    "hit_file": _SC + " select concat_ws(' ', concat_ws('/', sig.repo, sig.cve, sig.hsh, sig.file, sig.func), tg.path) as value from hs join sig using (sig_id) join tg on tg.fn_id = target_id",
    "threshold_grid": _SC + ", g as (select unnest(range(0, 101, 20)) as t) select c.t as cvg_least, p.t as pvg_least, count(sc.sig_id) as n_hits from g c cross join g p left join sc on pvg > nvg and cvg >= c.t and pvg >= p.t group by all",
    "char_jaccard": f"select p_partkey, round({_jaccard('p_name', 'p_type')}, 9) as similarity from part",
    "target_semi": _TG + " select fn_id, cve, func from tg where (cve, func) in (select cve, func from sig)",
    "target_names": _TG + " select fn_id, func from tg where func in (select func from sig)",
    "ground_truth_counts": _TG + " select count(*) filter (where role = 'vuln') as n_vuln, count(*) filter (where role = 'patch') as n_patch, count(*) filter (where role = 'before') as n_before, count(*) filter (where role = 'after') as n_after, count(*) filter (where role in ('vuln', 'before')) as n_vulnerable, count(*) filter (where role in ('patch', 'after')) as n_fixed from tg",
    "verdicts": _VERDICT + " select target_id, sig_id, verdict from vr",
    "eval_slices": _VERDICT + _SLICES + " select slice, tp, fp, tn, fn, unk, " + _RATES + " from k",
    "rate_lines": _VERDICT + _SLICES + ", r as (select slice, " + _RATES + " from k), w as (select slice, unnest(['nominal', 'worst', 'best']) as kind, unnest([p_nominal, p_worst, p_best]) as p, unnest([r_nominal, r_worst, r_best]) as q, unnest([f1_nominal, f1_worst, f1_best]) as f from r) select concat_ws(' ', slice, kind, coalesce(printf('%.6f', p), '-'), coalesce(printf('%.6f', q), '-'), coalesce(printf('%.6f', f), '-')) as value from w",
    "eval_zero_safe": _SC + _MOD + _CHANGED + ", k as (select count(*) filter (where verdict = 'TP') as tp, count(*) filter (where verdict = 'FP') as fp, count(*) filter (where verdict = 'TN') as tn, count(*) filter (where verdict = 'FN') as fn from w), q as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) as p, coalesce(tp::double / nullif(tp + fn, 0), 0) as r from k) select tp, fp, tn, fn, round(p, 9) as p_nominal, round(r, 9) as r_nominal, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1_nominal from q",
    "unchanged_filter": _TG + _MOD + " select fn_id, role from md",
    "line_diff": _TG.replace("with", "with recursive", 1) + _MOD + _LCS + f" select fn_id, added, removed, n as n_original, {_CLONE} as clone_type from y",
    "eval_test_modified": _SC + _MOD + _CHANGED + " select verdict, count(*) as n from w group by verdict",
    "asof_before": _COMMITS + ", k as (select c.*, (select max((x.ts, x.seq)) from c x where x.path = c.path and (x.ts, x.seq) < (c.ts, c.seq)) as b from c), m as (select k.*, case when b is not null then (select max((x.ts, x.seq)) from c x where x.path = k.path and x.ts <= k.ts - 2592000 and x.seq <> b[2]) end as m from k), h as (select m.*, case when m.m is not null then (select max((x.ts, x.seq)) from c x where x.path = m.path and x.ts <= m.ts - 15552000 and x.seq <> b[2] and x.seq <> m.m[2]) end as h from m) select path, ts, seq, b[2] as before_seq, m[2] as before_1mo_seq, h[2] as before_6mo_seq from h",
    "asof_after": _COMMITS + ", k as (select c.*, (select min((x.ts, x.seq)) from c x where x.path = c.path and (x.ts, x.seq) > (c.ts, c.seq)) as a, (select max((x.ts, x.seq)) from c x where x.path = c.path and (x.ts, x.seq) > (c.ts, c.seq) and x.ts <= c.ts + 2592000) as m, (select max((x.ts, x.seq)) from c x where x.path = c.path and (x.ts, x.seq) > (c.ts, c.seq) and x.ts <= c.ts + 15552000) as h from c), o as (select k.*, case when a is null then null when m is null then (select min((x.ts, x.seq)) from c x where x.path = k.path and (x.ts, x.seq) > k.a) else (select min((x.ts, x.seq)) from c x where x.path = k.path and (x.ts, x.seq) > k.m) end as b from k), s as (select o.*, case when b is null then null when h is null then (select min((x.ts, x.seq)) from c x where x.path = o.path and (x.ts, x.seq) > o.b) else (select min((x.ts, x.seq)) from c x where x.path = o.path and (x.ts, x.seq) > o.h) end as d from o) select path, ts, seq, a[2] as after_seq, b[2] as after_1mo_seq, d[2] as after_6mo_seq from s",
    "score_fuzzy": _FUZZY + " select sig_id, target_id, cvg, pvg, nvg from fz",
    "hits_fuzzy": _FUZZY + " select sig_id, target_id, cvg, pvg, nvg from fz where cvg > 50 and pvg > 50 and nvg < 50",
    "tale_node_score": _TALE + " select q_fn, t_fn, count(*) as n_pairs, round(sum(score), 6) as total from x where score > 0 group by all",
    "path_node_match": _DIRECTED + " select v_id as q_fn, p_id as t_fn, count(*) as n_pairs from sig join ix q on q.fn_id = v_id join ix t on t.fn_id = p_id and t.label = q.label and q.ind <= t.ind and q.outd <= t.outd and list_has_all(t.il, q.il) and list_has_all(t.ol, q.ol) and list_has_all(t.ir, q.ir) and list_has_all(t.outr, q.outr) group by all",
    "path_node_score": _DIRECTED + ", pr as (select v_id as q_fn, p_id as t_fn, greatest(q.ind - t.ind, 0) + greatest(q.outd - t.outd, 0) + len(list_filter(q.il, lambda x: not list_contains(t.il, x))) + len(list_filter(q.ol, lambda x: not list_contains(t.ol, x))) + len(list_filter(q.ir, lambda x: not list_contains(t.ir, x))) + len(list_filter(q.outr, lambda x: not list_contains(t.outr, x))) as lacking, q.ind + q.outd + len(q.il) + len(q.ol) + len(q.ir) + len(q.outr) as asked from sig join ix q on q.fn_id = v_id join ix t on t.fn_id = p_id and t.label = q.label), sx as (select q_fn, t_fn, coalesce(1.0::double - lacking::double / nullif(asked, 0), 1.0::double) as s from pr) select q_fn, t_fn, count(*) as n_pairs, round(sum(s), 6) as total from sx where s >= 0.5 group by all",
    # the best total for each set of query nodes, one target node after the other
    "assignment": _TALE.replace("with", "with recursive", 1) + """, im as (select fn_id, node_id from (select *, row_number() over (partition by fn_id order by degree desc, node_id desc) as r, count(*) over (partition by fn_id) as n from ix) where r <= greatest(1, floor(n * 0.2))),
wt as (select q_fn, t_fn, a, b, score as w, dense_rank() over (partition by q_fn, t_fn order by a) as i, dense_rank() over (partition by q_fn, t_fn order by b) as j from x join im on im.fn_id = q_fn and im.node_id = a where score > 0),
nw as (select q_fn, t_fn, j, list(i order by i) as iq, list(w order by i) as ws from wt group by all), mx as (select q_fn, t_fn, max(i) as k, max(j) as n from wt group by all),
dp as (select q_fn, t_fn, 0 as j, list_transform(range(0, 1 << k::int), lambda m: 0.0::double) as best from mx
  union all select dp.q_fn, dp.t_fn, dp.j + 1, list_transform(range(0, 1 << k::int), lambda m: greatest(best[m + 1], coalesce(list_max(list_transform(range(1, len(iq) + 1), lambda e: case when (m >> (iq[e] - 1)::int) & 1 = 1 then best[m - (1 << (iq[e] - 1)::int) + 1] + ws[e] else 0.0::double end)), 0.0::double))) from dp join mx using (q_fn, t_fn) join nw on nw.q_fn = dp.q_fn and nw.t_fn = dp.t_fn and nw.j = dp.j + 1)
select dp.q_fn, dp.t_fn, round(list_max(best), 6) as total, true as one, true as each from dp join mx on mx.q_fn = dp.q_fn and mx.t_fn = dp.t_fn and dp.j = n""",
    "connect_checks": _ALIGN + "select distinct sig_id, side, true as one, true as whole from ch",
    "components": "with recursive " + TARGET_SQL.lstrip() + """, e as (select fn_id as a, 'c:' || repo || '/' || cve as b from tg where cve is not null union select fn_id, 'h:' || hsh from tg), u as (select a, b from e union select b, a from e),
r as (select distinct a as node, a as seen from u union select r.node, u.b from r join u on u.a = r.seen) select node, min(seen) as component from r group by node""",
    "first_productive": "select seq, repo, cve, n_files from (select *, row_number() over (partition by repo, cve order by seq) as r from (select o_orderkey as seq, o_orderpriority as repo, o_custkey as cve, count(*) as n_files from orders join lineitem on l_orderkey = o_orderkey group by all having count(*) between 1 and 5)) where r = 1",
    "diff_parse": _DIFFS + ", f as (select *, regexp_extract(head, '[a-zA-Z0-9_]*\\.c[pp]*') as file, substr(regexp_extract(head, 'a/[/a-zA-Z0-9_-]*\\.c[pp]*'), 3) as path from h), n as (select repo, hsh, src_id, list_sort(list(distinct name)) as names from (select *, regexp_extract_all(line, '([a-zA-Z0-9_]*)\\(', 1)[-1] as name from l where contains(line, '@@')) where name <> '' group by all) select repo, hsh, k as segment, file, path, old_id, new_id, array_to_string(names, ',') as funcs from f join n using (repo, hsh, src_id) where file <> '' and all_files between 1 and 5",
    "diff_versions": _DIFFS + ", f as (select *, regexp_extract(head, '[a-zA-Z0-9_]*\\.c[pp]*') as file, substr(regexp_extract(head, 'a/[/a-zA-Z0-9_-]*\\.c[pp]*'), 3) as path from h), n as (select distinct repo, hsh, src_id from (select *, regexp_extract_all(line, '([a-zA-Z0-9_]*)\\(', 1)[-1] as name from l where contains(line, '@@')) where name <> ''), b as (select substr(sha256(content), 1, 7) as short, arg_min(length(content), sha256(content)) as n_chars from vuln_patch_src_db where content is not null group by 1) select repo, hsh, file, path, role, n_chars from (select repo, hsh, src_id, file, path, 'vuln' as role, old_id as short from f union all select repo, hsh, src_id, file, path, 'patch', new_id from f) join n using (repo, hsh, src_id) join b using (short) where file <> ''",
    "cve_commits": "select src_id, cve from (select src_id, regexp_extract(m, 'CVE-[0-9]*-[0-9]*') as cve, m from (select src_id, 'see ' || coalesce(cve, 'nothing') || ' in ' || coalesce(path, '-') as m from vuln_patch_src_db where coalesce(role, '') <> 'before')) where contains(m, 'CVE-20') and cve <> ''",
    "new_commits": "select distinct repo, hsh from vuln_patch_src_db where repo is not null and hsh is not null and (repo, hsh) not in (select (repo, hsh) from funcs where repo is not null and hsh is not null)",
    "mined_commits": _DIFFS + " select repo, hsh, count(*) as n_files, arg_min(cve, src_id) as cve, case when count(*) > 5 then 'too many files' when count(cve) = 0 then 'no CVE' end as reason from h group by all",
    "mine_counters": _DIFFS + ", c as (select repo, hsh, count(*) <= 5 and count(cve) > 0 as ok from h group by all) select repo, count(*) filter (where ok) as n_processed, count(*) filter (where not ok) as n_skipped from c group by all",
    "after_ancestry": _ANCESTRY,
    "align_nodes": _ALIGN + "select sig_id, v_node, p_node from mp",
    "changed_nodes": _ALIGN + "select sig_id, side, node_id from ch",
    "induced_edges": _ALIGN + "select a.sig_id, a.side, src, dst, min(rel) as rel from ge join ch a on a.fn_id = ge.fn_id and a.node_id = src join ch b on b.fn_id = ge.fn_id and b.node_id = dst and b.sig_id = a.sig_id and b.side = a.side group by all",
    "context_nodes": _ALIGN + "select distinct m.sig_id, v_node as node_id from mp m join sig using (sig_id) where (m.sig_id, v_node) not in (select sig_id, node_id from ch where side = 'v') and (m.sig_id, p_node) not in (select sig_id, node_id from ch where side = 'p') and (exists (select 1 from nb join ch on ch.fn_id = nb.fn_id and ch.node_id = y and side = 'v' where nb.fn_id = v_id and x = v_node and ch.sig_id = m.sig_id) or exists (select 1 from nb join ch on ch.fn_id = nb.fn_id and ch.node_id = y and side = 'p' where nb.fn_id = p_id and x = p_node and ch.sig_id = m.sig_id))",
    "expand_1hop": _ALIGN + "select sig_id, side, node_id from ch union select sig_id, side, y from ch join nb on nb.fn_id = ch.fn_id and x = node_id",
    "two_hop": f"{_G} select distinct x.fn_id, x.src as node_id, y.dst as hop2 from ge x join ge y on y.fn_id = x.fn_id and y.src = x.dst where x.src <> y.dst",
    "bfs_tree": _TRADE + " select root, node, parent, depth from tree",
    "subtree_size": _TRADE + ", up as (select node, node as top from tree union all select up.node, tree.parent from up join tree on tree.node = up.top where tree.parent is not null) select top as node, count(*) as size from up group by top",
    "nh_index": _INDEX + " select fn_id, node_id, label, degree, array_to_string(labels, ',') as labels, links from ix",
    "important_nodes": _INDEX + " select fn_id, node_id, degree from (select *, row_number() over (partition by fn_id order by degree desc, node_id desc) as r, count(*) over (partition by fn_id) as n from ix) where r <= greatest(1, floor(n * 0.2))",
    # partial images of the first k nodes, grown by one node at a time
    "exact_match": f"""with recursive {GRAPH_SQL.lstrip()},{TARGET_SQL},
ns as (select fn_id, list(node_id order by seq) as ids, list(type order by seq) as types from gs group by fn_id), es as (select fn_id, map_from_entries(list((src || '|' || dst, rel))) as rels from g1 group by fn_id),
gr as (select ns.fn_id, ids, types, coalesce(rels, map([], [])) as rels from ns left join es using (fn_id)),
pr as (select v_id as q_fn, p_id as t_fn, q.ids as qi, q.types as qt, q.rels as qr, t.ids as ti, t.types as tt, t.rels as tr from sig join gr q on q.fn_id = v_id join gr t on t.fn_id = p_id),
im as (select q_fn, t_fn, 0 as k, []::varchar[] as m from pr
  union all select * from (select q_fn, t_fn, k + 1 as k, list_append(m, c) as m from (select im.q_fn, im.t_fn, k, im.m, qi, qt, qr, tt, tr, unnest(ti) as c, unnest(tt) as ct from im join pr on pr.q_fn = im.q_fn and pr.t_fn = im.t_fn where k < len(qi))
    where ct = qt[k + 1] and not list_contains(m, c) and len(list_filter(range(1, k + 2), lambda i: tr[coalesce(m[i], c) || '|' || c] is distinct from qr[qi[i] || '|' || qi[k + 1]] or tr[c || '|' || coalesce(m[i], c)] is distinct from qr[qi[k + 1] || '|' || qi[i]])) = 0))
select pr.q_fn, pr.t_fn, case when exists (select 1 from im where im.q_fn = pr.q_fn and im.t_fn = pr.t_fn and k = len(qi)) then 100.0::double else 0.0::double end as score, 0 as n_mapped from pr""",
    "match_checks": f"with{GRAPH_SQL},{TARGET_SQL}, pr as (select 1 from sig where v_id in (select fn_id from gn) and p_id in (select fn_id from gn)) select how, (select count(*) from pr) as n_pairs, 0 as n_wrong from (values ('tolerant'), ('path')) h(how)",
    "aligned_checks": f"with{GRAPH_SQL},{TARGET_SQL} select sig_id, true as positive, true as negative from sig where v_id in (select fn_id from gn) and p_id in (select fn_id from gn)",
    "edge_pattern_iso": f"{_G} select distinct x.fn_id, x.src as a, x.dst as b, y.dst as c from ge x join ge y on y.fn_id = x.fn_id and y.src = x.dst and y.rel = 'FLOWS_TO' join gn na on na.fn_id = x.fn_id and na.node_id = x.src and na.type = 'Callee' join gn nb on nb.fn_id = x.fn_id and nb.node_id = x.dst and nb.type = 'ArgumentList' join gn nc on nc.fn_id = x.fn_id and nc.node_id = y.dst and nc.type = 'ExpressionStatement' where x.rel = 'FLOWS_TO' and not exists (select 1 from ge z where z.fn_id = x.fn_id and z.src in (x.src, x.dst, y.dst) and z.dst in (x.src, x.dst, y.dst) and not (z.rel = 'FLOWS_TO' and (z.src, z.dst) in ((x.src, x.dst), (y.src, y.dst)) or z.rel = 'REACHES' and z.src = x.src and z.dst = y.dst)) and exists (select 1 from ge z where z.fn_id = x.fn_id and z.src = x.src and z.dst = y.dst and z.rel = 'REACHES')",
}
