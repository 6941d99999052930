"""Small inputs with answers worked out by hand."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from triloom import __main__ as cli
from triloom.functions import scalars
from triloom.operators import align, dense, evaluate, graphalg, history, ingest, match, matchers, signature, structure, triples
from triloom.sources import readers, writers


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


NODES = "file_id string, row_no int, key string, type string, code string, location string, function_id string"
FILE = [("x", 1, "f0", "File", "", "", ""), ("x", 2, "F1", "Function", "foo", "1:0:0:9", ""), ("x", 3, "n1", "A", "x", "", ""), ("x", 4, "n2", "B", "", "", ""), ("x", 5, "F2", "Function", "bar", "", ""), ("x", 6, "n3", "C", "", "", "")]


def test_functions_by_row_order(spark):
    rows = df(spark, NODES, *FILE)
    assert got(ingest.sessionize(rows), "func", "key") == [("bar", "n3"), ("foo", "n1"), ("foo", "n2")]
    assert got(ingest.sessionize(rows, names=df(spark, "func string", ("bar",))), "func", "key") == [("bar", "n3")]


def test_edges_stay_within_their_function(spark):
    nodes = ingest.sessionize(df(spark, NODES, *FILE))
    edges = df(spark, "file_id string, src string, dst string, rel string", ("x", "n1", "n2", "USE"), ("x", "n1", "n2", "USE"), ("x", "n2", "n3", "DOM"), ("y", "n1", "n2", "USE"), ("x", "f0", "n1", "DOM"))
    assert got(ingest.attach_edges(nodes, edges), "src", "dst", "rel") == [("n1", "n2", "USE")] * 2
    assert got(ingest.dropped_edges(nodes, edges), "*") == [("x", 4, 2), ("y", 1, 0)]


def test_last_row_wins(spark):
    rows = df(spark, "k string, o int, v string", ("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None))
    assert [tuple(r) for r in ingest.last_wins(rows, ["k"], ["o"]).orderBy("k").collect()] == [("a", 3, "y"), ("b", 1, None)]


GN = "fn_id string, node_id string, type string, code string"
GE = "fn_id string, src string, dst string, rel string"


def test_triples(spark):
    edges = df(spark, GE, ("f", "n1", "n2", "USE"), ("f", "n2", "n3", "FLOWS_TO"))
    nodes = lambda c: df(spark, GN, ("f", "n1", "A", "x"), ("f", "n2", "B", c), ("f", "n3", "CFGExitNode", "EXIT"))
    assert got(triples.tripleize(edges, nodes("")), "a", "rel", "b") == [("A", "USE", "B"), ("x", "USE", "B")]
    assert got(triples.tripleize(edges, nodes(None)), "a", "b") == [("A", "B"), ("x", "B")]
    assert got(triples.tripleize(edges, nodes("y")), "a", "b") == [("A", "B"), ("A", "y"), ("x", "B"), ("x", "y")]


def test_parallel_edges_count_squared(spark):
    edges = df(spark, GE, ("f", "n1", "n2", "USE"), ("f", "n1", "n2", "USE"), ("f", "n1", "n2", "DEF"), ("f", "n2", "n1", "DEF"))
    assert got(triples.edge_counts(edges), "rel", "n") == [("DEF", 4), ("USE", 6)]
    assert got(triples.edge_counts(edges, dedup_parallel=True), "rel", "n") == [("DEF", 2), ("USE", 2)]
    nodes = df(spark, GN, ("f", "n1", "Symbol", ""), ("f", "n2", "Odd", ""), ("g", "n1", "Odd", ""))
    vec = {r.fn_id: r.vec for r in triples.vectorize(nodes, edges).collect()}
    assert len(vec["f"]) == 79 and (vec["f"][7], vec["f"][8], vec["f"][18], sum(vec["f"])) == (6, 4, 1, 11) and sum(vec["g"]) == 0


SIG = "sig_id string, repo string, cve string, hsh string, file string, func string, v_id string, p_id string"
TR = "fn_id string, a string, rel string, b string"


def parts_of(spark, v, p, sid="s"):
    sig = df(spark, SIG, (sid, "r", "C", "h_5", "f", "g", "v", "p"))
    return sig, signature.parts(sig, df(spark, TR, *[("v", t, "r", "b") for t in v], *[("p", t, "r", "b") for t in p]))


def test_signature_parts_and_rejects(spark):
    sig, parts = parts_of(spark, ["1", "2", "3"], ["2", "3", "4", "4"])
    assert got(parts, "part", "a") == [("cvg", "2"), ("cvg", "3"), ("nvg", "4"), ("pvg", "1")]
    assert signature.accepted(parts).count() == 4
    sig, parts = parts_of(spark, ["1", "2"], ["2"])
    assert signature.accepted(parts).count() == 0
    assert got(signature.stats(sig, parts), "n_cvg", "n_pvg", "n_nvg", "n_v", "n_p", "ok") == [(1, 1, 0, 2, 1, False)]


@pytest.mark.parametrize("target,want,scan,ev", [(["1", "2"], (50, 100, 0), 0, 1), (["1", "2", "3"], (100, 100, 0), 1, 1), (["2", "3", "4"], (100, 0, 100), 0, 0)])
def test_exact_scores(spark, target, want, scan, ev):
    _, parts = parts_of(spark, ["1", "2", "3"], ["2", "3", "4"])
    tg = df(spark, TR, *[("t", x, "r", "b") for x in target])
    assert got(match.score_exact(parts, tg), "cvg", "pvg", "nvg") == [want]
    assert (match.hits_scan(parts, tg).count(), match.hits_eval(parts, tg).count()) == (scan, ev)


def test_pruned_hits_are_all_hits(spark):
    r = random.Random(2)
    pool = [str(i) for i in range(30)]
    rows = [(f"f{i}", t, "r", "b") for i in range(60) for t in r.sample(pool, r.randint(3, 25))]
    tr = df(spark, TR, *rows)
    sig = df(spark, SIG, *[(f"f{i}", "r", "C", "h", "f", "g", f"f{i}", f"f{i + 1}") for i in range(0, 40, 2)])
    parts = signature.accepted(signature.parts(sig, tr)).cache()
    dense = match.score_exact(parts, tr)
    c = [F.col(x) for x in match.PARTS]
    assert got(match.hits_scan(parts, tr), "sig_id", "target_id", "cvg") == got(dense.where(scalars.is_scan_hit(*c)), "sig_id", "target_id", "cvg")
    assert got(match.hits_eval(parts, tr), "sig_id", "target_id", "pvg") == got(dense.where(scalars.is_eval_hit(*c)), "sig_id", "target_id", "pvg")
    plan = dense._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_character_similarity(spark):
    rows = df(spark, "a string, b string", ("abc", "abd"), ("ab", "cd"), ("aab", "ab"), ("", ""), ("", "a"), ("é\U0001f600", "é"))
    assert [round(r[0], 6) for r in rows.select(scalars.char_jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0, 1.0, 0.0, 0.5]


def test_fuzzy_scores(spark):
    _, parts = parts_of(spark, ["abc", "x"], ["x", "y"])
    pairs = df(spark, "sig_id string, target_id string", ("s", "t"), ("s", "u"))
    tg = df(spark, TR, ("t", "x", "r", "b"), ("t", "abd", "r", "b"), ("u", "abc", "other", "b"), ("u", "zz", "r", "b"))
    assert got(match.score_fuzzy(pairs, parts, tg), "target_id", "cvg", "pvg", "nvg") == [("t", 100.0, 75.0, 0.0), ("u", 0.0, 0.0, 0.0)]


def test_exact_scores_of_all_targets(spark, monkeypatch):
    r = random.Random(9)
    tr = df(spark, TR, *[(f"f{i}", r.choice("abcd"), "r", r.choice("xyz")) for i in range(50) for _ in range(r.randint(1, 9))], (None, "a", "r", "x"), ("f0", None, "r", "x"))
    parts = df(spark, "sig_id string, part string, a string, rel string, b string", *{(f"s{i}", p, r.choice("abcde"), "r", r.choice("xyz")) for i in range(9) for p in match.PARTS for _ in range(r.randint(0, 5))})
    text = lambda rows: sorted(str(tuple(x)) for x in rows.collect())
    want = text(match.score_exact(parts, tr).select("sig_id", "target_id", *match.PARTS))
    assert text(dense.score_exact(parts, tr)) == want and "None" in str(want)
    monkeypatch.setattr(dense, "SIG_BLOCK", 30)
    monkeypatch.setattr(dense, "TARGET_CHUNK", 40)
    assert text(dense.score_exact(parts, tr)) == want
    assert dense.score_exact(parts.limit(0), tr).count() == 0 == dense.score_exact(parts, tr.limit(0)).count()


def test_fuzzy_scores_of_all_targets(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(0, 4)))
    rows = {(f"f{i}", word(), r.choice("xy"), word()) for i in range(24) for _ in range(r.randint(2, 14))}
    tr = df(spark, TR, *rows, (None, "a", "x", "b"), ("f1", None, "x", "b"))
    parts = df(spark, "sig_id string, part string, a string, rel string, b string", *{(f"s{i}", p, word(), r.choice("xy"), word()) for i in range(6) for p in match.PARTS for _ in range(r.randint(1, 8))})
    targets = [f"f{i}" for i in range(24)]
    pairs = df(spark, "sig_id string, target_id string", *[(f"s{i}", t) for i in range(6) for t in targets])
    want = got(match.score_fuzzy(pairs, parts, tr), "sig_id", "target_id", *match.PARTS)
    assert got(dense.score_all(parts, tr), "sig_id", "target_id", *match.PARTS) == [x for x in want if x[2] > 0]
    assert got(dense.score_all(parts, tr, floor=50.0), "sig_id", "target_id", *match.PARTS) == [x for x in want if x[2] > 50]

    # the command line finds a clone under another CVE and another name
    fn = lambda i, cve, role, func: (i, "r", cve, f"d/r/{cve}/{role}/h_1/f.c/graph/{func}.gpickle", "x", None)
    df(spark, "fn_id string, repo string, cve string, path string, code string, loaded_at timestamp", fn("v", "C-1", "vuln", "g"), fn("p", "C-1", "patch", "g"), fn("c", "D-2", "vuln", "other")).write.parquet(f"{tmp_path}/data/funcs.parquet")
    own = lambda i, *names: [(i, n, "x", "n") for n in names]
    df(spark, TR, *own("v", "read", "kqz"), *own("p", "read", "0123"), *own("c", "reads", "kqzw")).write.parquet(f"{tmp_path}/data/triples.parquet")
    tg = signature.targets(spark.read.parquet(f"{tmp_path}/data/funcs.parquet"))
    own_sig = signature.pairs(tg)
    own_sig.write.parquet(f"{tmp_path}/sig/sig")
    signature.accepted(signature.parts(own_sig, spark.read.parquet(f"{tmp_path}/data/triples.parquet"))).write.parquet(f"{tmp_path}/sig/sig_parts")
    cli.scan(spark, f"{tmp_path}/data", f"{tmp_path}/sig", f"{tmp_path}/out", "a")
    assert any("D-2" in x.value for x in spark.read.text(f"{tmp_path}/out/hits").collect())


def test_score_files_have_a_line_for_every_pair(spark, tmp_path):
    fn = lambda i, cve, role: (i, "r", cve, f"d/r/{cve}/{role}/h_1/f.c/graph/g.gpickle", "x", None)
    df(spark, "fn_id string, repo string, cve string, path string, code string, loaded_at timestamp", fn("v", "C-1", "vuln"), fn("p", "C-1", "patch"), fn("z", "D-2", "before")).write.parquet(f"{tmp_path}/data/funcs.parquet")
    df(spark, TR, *[(i, n, "x", "n") for i, names in (("v", ("read", "kqz")), ("p", ("read", "0123"))) for n in names], ("z", "zz", "other", "zz")).write.parquet(f"{tmp_path}/data/triples.parquet")
    sig = signature.pairs(signature.targets(spark.read.parquet(f"{tmp_path}/data/funcs.parquet")))
    sig.write.parquet(f"{tmp_path}/sig/sig")
    signature.accepted(signature.parts(sig, spark.read.parquet(f"{tmp_path}/data/triples.parquet"))).write.parquet(f"{tmp_path}/sig/sig_parts")
    for how in "ea":
        cli.scan(spark, f"{tmp_path}/data", f"{tmp_path}/sig", f"{tmp_path}/{how}", how)
        lines = [r.value for r in spark.read.text(f"{tmp_path}/{how}/scores").collect()]
        assert len(lines) == 3 and [x for x in lines if x.endswith(" 0 0 0")] == ["r/C-1/h_1/f.c/g d/r/D-2/before/h_1/f.c/graph/g.gpickle 0 0 0"]


TG = "fn_id string, repo string, cve string, role string, hsh string, file string, func string, epoch long, path string, code string"


def target(i, role, func="g", epoch=9, cve="C-1", code="x"):
    return (i, "r", cve, role, f"h_{epoch}", "f", func, epoch, f"d/r/{cve}/{role}/h_{epoch}/f/graph/{func}.gpickle", code)


def test_verdicts_and_rates(spark):
    tg = df(spark, TG, target("a", "patch"), target("b", "before"), target("c", "vuln"), target("d", "after"), target("e", "vuln", cve="D-2", epoch=3), target("f", "vuln", cve="D-2", epoch=9), target("g", "after", func="o", cve="E-3"))
    sig = df(spark, SIG, ("s", "r", "C-1", "h_5", "f", "g", "v", "p"), ("t", "r", "C-1", "h_6", "f", "o", "v", "p"))
    hits = df(spark, "target_id string, sig_id string", ("c", "s"), ("c", "t"), ("d", "s"), ("e", "s"), ("f", "s"), ("g", "s"))
    labels = df(spark, "line_no int, verdict string, cve string, path_part string", (2, "TP", "C-1", "E-3"), (1, "FP", "C-1", "/o.gp"), (3, "TP", "X", "D-2"))
    v = evaluate.verdicts(tg, sig, hits, labels)
    assert got(v, "target_id", "verdict") == [("a", "TN"), ("b", "FN"), ("c", "TP"), ("c", "TP"), ("d", "FP"), ("e", "TP"), ("f", "UNK"), ("g", "FP")]
    counts = {r.slice: r for r in evaluate.confusion(v).collect()}
    assert tuple(counts["all"])[1:] == (3, 2, 1, 1, 1) and tuple(counts["test"])[1:] == (0, 2, 0, 1, 0)
    rates = evaluate.rates(df(spark, "slice string, tp long, fp long, tn long, fn long, unk long", ("m", 6, 2, 0, 2, 2), ("z", 0, 0, 0, 0, 0))).collect()
    assert [round(rates[0][f"{m}_{k}"], 6) for k in ("nominal", "worst", "best") for m in ("p", "r", "f1")] == [0.75, 0.75, 0.75, 0.6, 0.75, 0.666667, 0.8, 0.8, 0.8]
    assert rates[1].p_nominal is None and rates[1].f1_best is None


def test_modified_targets(spark):
    tg = df(spark, TG, target("v", "vuln", code="a\nb\n"), target("p", "patch", code="a\nc\n"), target("b1", "before", code="a\nb\n", epoch=1), target("b2", "before", code="a\nx\nb\n", epoch=2), target("a1", "after", code="a\nb\n", epoch=11), target("n", "before", code=None), target("o", "before", func="other", code="q"))
    m = evaluate.clone_types(evaluate.line_diff(evaluate.modified(tg)))
    assert got(m, "fn_id", "added", "removed", "n_original", "clone_type") == [("a1", 1, 1, 2, 2), ("b2", 1, 0, 2, 3)]
    sig = df(spark, SIG, ("s", "r", "C-1", "h_5", "f", "g", "v", "p"))
    hits = df(spark, "target_id string, sig_id string", ("b2", "s"))
    assert got(evaluate.modified_verdicts(m, sig, hits), "fn_id", "verdict") == [("a1", "TN"), ("b2", "TP")]


def test_clone_types(spark):
    rows = df(spark, "a int, r int, o int", (3, 3, 10), (5, 1, 10), (3, 2, 10))
    assert [x[0] for x in rows.select(scalars.clone_type(F.col("a"), F.col("r"), F.col("o"))).collect()] == [2, 4, 3]


def test_line_diff_is_minimal():
    from difflib import SequenceMatcher

    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        added, removed, _ = evaluate._diff("\n".join(a), "\n".join(b))
        assert (added, removed) == (len(b) - table[-1][-1], len(a) - table[-1][-1]), SequenceMatcher


DAY = 86400


def test_versions_before_and_after(spark):
    c = df(spark, "path string, ts long, seq long", *[("p", d * DAY, d) for d in (0, 50, 170, 190, 200)], ("q", 5, 1))
    before = {(r.path, r.seq): tuple(r)[3:] for r in history.versions_before(c).collect()}
    assert before["p", 200] == (190, 170, 0) and before["p", 0] == (None, None, None) and before["p", 190] == (170, 50, 0) and before["p", 50] == (0, None, None)
    c = df(spark, "path string, ts long, seq long", *[("p", d * DAY, d) for d in (0, 10, 20, 50, 100, 300)], *[("q", d * DAY, d) for d in (0, 40, 50, 200)])
    after = {(r.path, r.seq): tuple(r)[3:] for r in history.versions_after(c).collect()}
    assert after["p", 0] == (10, 50, 300) and after["q", 0] == (40, 50, 200) and after["p", 300] == (None, None, None)


def plainly(commits):
    """Both look-ups for the commits (ts, seq) of one path, by their definition."""
    c = sorted(commits)
    newest = lambda xs, *taken: next((x[1] for x in sorted(xs, reverse=True) if x[1] not in taken), None)
    oldest = lambda xs, *taken: next((x[1] for x in sorted(xs) if x[1] not in taken), None)
    out = {}
    for t, q in c:
        old, new = [x for x in c if x < (t, q)], [x for x in c if x > (t, q)]
        b = newest(old)
        m = newest([x for x in c if x[0] <= t - 30 * DAY], b) if b is not None else None
        h = newest([x for x in c if x[0] <= t - 180 * DAY], b, m) if m is not None else None
        after = [oldest(new)]
        for days in (30, 180):
            if after[-1] is None:
                after.append(None)
                continue
            within = [x for x in new if x[0] <= t + days * DAY]
            after.append(oldest([x for x in new if x > max(within)]) if within else oldest(new, *after))
        out[q] = (b, m, h, *after)
    return out


def test_versions_of_paths_of_any_density(spark):
    r = random.Random(8)
    rows = [("hot", r.randint(0, 900) * DAY, i) for i in range(400)] + [(p, r.randint(0, 4000) * DAY, 1000 + 20 * k + i) for k, p in enumerate("abcdefgh") for i in range(r.randint(1, 15))]
    rows += [("gap", t * DAY, 9000 + t) for t in (0, 1, 2, 700, 1500, 1501, 2400, 2401)]
    c = df(spark, "path string, ts long, seq long", *rows)
    before = {r.seq: tuple(r)[3:] for r in history.versions_before(c).collect()}
    after = {r.seq: tuple(r)[3:] for r in history.versions_after(c).collect()}
    for p in {x[0] for x in rows}:
        for q, want in plainly([x[1:] for x in rows if x[0] == p]).items():
            assert (*before[q], *after[q]) == want, (p, q)


DIFF = """diff --git a/libx/gif.c b/libx/gif.c
index 12ab..34cd 100644
@@ -1,2 +1,3 @@ static int foo(bar(x
@@ -9,2 +9,3 @@ baz(
diff --git a/a.h b/a.h
index 1..2
@@ -1 +1 @@ no(
diff --git a/b.cpp b/b.cpp
@@ -1 +1 @@ early(
index 3..4
@@ -1 +1 @@ late(
@@ -5 +5 @@ none"""


def test_diffs(spark):
    lines = df(spark, "hash string, line_no int, line string", *[("h", i, x) for i, x in enumerate(DIFF.split("\n"))])
    out = sorted((r.file, r.path, r.old_id, r.new_id, tuple(r.funcs)) for r in history.parse_diffs(lines, ["hash"]).collect())
    assert out == [("b.cpp", "b.cpp", "3", "4", ("late",)), ("gif.c", "libx/gif.c", "12ab", "34cd", ("bar", "baz"))]
    assert got(history.small_commits(lines, ["hash"]), "n_files") == [(3,)]


def test_commits(spark):
    c = df(spark, "hash string, is_merge boolean, message string", ("a", False, "Fix CVE-2014-12 and CVE-2015-1"), ("b", True, "CVE-2014-1"), ("c", False, "nothing"), ("d", False, "about CVE-20"))
    assert got(history.cve_commits(c), "hash", "cve") == [("a", "CVE-2014-12")]
    assert got(history.not_known(c, df(spark, "hash string", ("a",), ("b",)), ["hash"]), "hash") == [("c",), ("d",)]


COMMITS = "repo string, hash string, ts long, seq long, parents array<string>, paths array<string>"


def below(parents):
    """For each commit its descendants, by following every link."""
    kids = {}
    for c, ps in parents.items():
        for p in ps:
            kids.setdefault(p, set()).add(c)
    out = {}
    for c in parents:
        todo, seen = [c], set()
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out[c] = seen
    return out


def test_descendants_of_a_long_chain(spark):
    n = 5000
    rows = [("r", str(i), n - i if i % 2 else i, i, [str(i - 1)] if i else [], []) for i in range(n)]  # times in no order
    d = history.descendants(df(spark, COMMITS, *rows), df(spark, "repo string, hash string", ("r", "0"), ("r", "4000"), ("r", "9999"), ("s", "0"), (None, "0")))
    assert {r.root: r.n for r in d.groupBy("root").agg(F.count_distinct("hash").alias("n")).collect()} == {"0": n - 1, "4000": 999} and d.count() == n + 998


def test_descendants_and_later_versions_in_merged_histories(spark):
    r = random.Random(3)
    for trial in range(3):
        names = [f"c{i:02d}" for i in range(40)]
        parents = {c: sorted({r.choice(names[max(0, i - 5) : i]) for _ in range(r.choice([1, 1, 2]))}) if i and r.random() > 0.05 else [] for i, c in enumerate(names)}
        parents["c07"] = [*parents["c07"], "gone"]
        ts = {c: (i * 20 + r.randint(-30, 30)) * DAY for i, c in enumerate(names)}
        paths = {c: r.sample("pq", r.randint(0, 2)) for c in names}
        commits = df(spark, COMMITS, *[("r", c, ts[c], i, parents[c], paths[c]) for i, c in enumerate(names)], ("r", "c03", ts["c03"], 3, parents["c03"], paths["c03"]))
        reach = below(parents)
        got_d = got(history.descendants(commits, df(spark, "repo string, hash string", *[("r", c) for c in names])), "root", "hash")
        assert got_d == sorted((c, x) for c in names for x in reach[c])
        order = lambda c: (ts[c], names.index(c))
        want = []
        for c in names:
            for p in paths[c]:
                new = sorted((x for x in reach[c] if p in paths[x]), key=order)
                picks = [new[0] if new else None]
                for days in (30, 180):
                    if picks[-1] is None:
                        picks.append(None)
                        continue
                    within = [x for x in new if ts[x] <= ts[c] + days * DAY]
                    rest = sorted((x for x in reach[within[-1]] if p in paths[x]), key=order) if within else [x for x in new if x not in picks]
                    picks.append(rest[0] if rest else None)
                want.append((p, c, *picks))
        roots = df(spark, "repo string, hash string, path string", *[("r", c, p) for c in names for p in paths[c]])
        text = lambda rows: sorted(map(str, rows))
        assert text(got_rows(history.versions_along(commits, roots), "path", "hash", "after", "after_1mo", "after_6mo")) == text(want)


def got_rows(frame, *cols):
    return [tuple(x) for x in frame.select(*cols).collect()]


def test_mined_commits_and_versions(spark):
    text = {"a": "fix CVE-2001-1, CVE-2002-2\n" + DIFF, "b": DIFF, "c": "CVE-2003-3", "d": "CVE-2004-4\n" + "diff --git a/x.c b/x.c\n" * 6, "e": "CVE-2005-5\n" + DIFF}
    lines = df(spark, "repo string, hash string, line_no int, line string", *[("r", h, i, x) for h, t in text.items() for i, x in enumerate(t.split("\n"))])
    m = history.mined(lines, ["repo", "hash"], df(spark, "repo string, cve string", ("r", "CVE-2005-5")))
    assert sorted(map(str, got_rows(m, "hash", "n_files", "cve", "reason"))) == sorted(map(str, [("a", 3, "CVE-2001-1", None), ("b", 3, None, "no CVE"), ("c", 0, "CVE-2003-3", "no file"), ("d", 6, "CVE-2004-4", "too many files"), ("e", 3, "CVE-2005-5", "CVE covered already")]))
    assert got(history.counters(m, ["repo"]), "*") == [("r", 1, 4)]
    blobs = df(spark, "blob_id string, content string", ("12abff", "old"), ("34cd00", "new"), ("3", "three"), ("99", "x"))
    v = history.with_versions(history.parse_diffs(lines.where("hash = 'a'"), ["hash"]), blobs, ["hash"])
    assert got(v, "path", "role", "content") == [("b.cpp", "vuln", "three"), ("libx/gif.c", "patch", "new"), ("libx/gif.c", "vuln", "old")]
    at = history.versions_at(df(spark, "cve string, commit string, path string, role string", ("C", "k", "p", "after"), ("C", "k", "q", "after")), df(spark, "commit string, path string, content string", ("k", "p", "text")), ["cve"])
    assert got(at, "*") == [("C", "k", "p", "after", "text")]


def greedy(v, p):
    heads, m, taken = {}, {}, set()
    for n in p:
        heads.setdefault(n[1], n[0])
    for n in v:
        if n[1] in align.SKELETON and n[1] in heads:
            m[n[0]] = heads[n[1]]
            taken.add(heads[n[1]])
    for n in v:
        if n[0] not in m:
            for q in p:
                if q[0] not in taken and q[1:5] == n[1:5]:
                    m[n[0]] = q[0]
                    taken.add(q[0])
                    break
    return m


def test_alignment_equals_taking_the_first_free_node(spark):
    r = random.Random(4)
    rows, sigs, want = [], [], []
    for k in range(25):
        side = {}
        for s in "vp":
            side[s] = [(f"{s}{k}_{i:02d}", r.choice(["A", "B", "CFGEntryNode", "FunctionDef"]), r.choice(["x", "y"]), r.randint(0, 1), 0) for i in range(r.randint(0, 14))]
            rows += [(f"{s}{k}", *n, i) for i, n in enumerate(side[s])]
        sigs.append((f"s{k}", "r", "c", "h", "f", "g", f"v{k}", f"p{k}"))
        want += [(f"s{k}", a, b) for a, b in greedy(side["v"], side["p"]).items()]
    nodes = df(spark, "fn_id string, node_id string, type string, code string, in_deg int, out_deg int, seq int", *rows)
    assert got(align.align_nodes(df(spark, SIG, *sigs), nodes), "sig_id", "v_node", "p_node") == sorted(want)


def graph(spec, edges):
    return matchers.Graph([{"node_id": n, "type": t, "code": ""} for n, t in spec.items()], [{"src": a, "dst": b, "rel": r} for a, b, r in edges])


def test_induced_subgraphs():
    q = graph({"0": "t0", "1": "t1"}, [("0", "1", "e0")])
    t = {"2": "t0", "3": "t1", "4": "t2"}
    e = [("2", "3", "e0"), ("3", "4", "e2")]
    assert matchers.exact_match(q, graph(t, e)) == ({}, 100.0)
    assert matchers.exact_match(q, graph(t, [*e, ("3", "2", "e0")])) == ({}, 0.0)


def test_induced_subgraphs_by_trying_all():
    r = random.Random(1)
    found = 0
    for _ in range(150):
        g = []
        for n in (3, 5):
            names = {f"n{i}": r.choice("ab") for i in range(n)}
            g.append(graph(names, [(x, y, r.choice("uv")) for x in names for y in names if x != y and r.random() < 0.3]))
        q, t = g
        ql, want = sorted(q.label), False
        for image in permutations(sorted(t.label), len(ql)):
            m = dict(zip(ql, image))
            want |= all(q.label[x] == t.label[m[x]] for x in ql) and all(q.rel.get((x, y)) == t.rel.get((m[x], m[y])) for x in ql for y in ql)
        found += want
        assert matchers.exact_match(q, t)[1] == (100.0 if want else 0.0)
    assert 10 < found < 140


def test_assignment_by_trying_all():
    r = random.Random(3)
    for _ in range(100):
        w = {(a, b): r.randint(1, 9) / 2 for a in "abc" for b in "xyzw" if r.random() < 0.6}
        best = max(sum(w.get((a, p[i]), 0) for i, a in enumerate("abc")) for p in permutations(["x", "y", "z", "w", None, None, None], 3))
        m = matchers.assignment(w) if w else {}
        assert len(set(m.values())) == len(m) and abs(sum(w[a, b] for a, b in m.items()) - best) < 1e-9


TOY = ({"1": "one", "2": "two", "3": "three", "4": "four", "5": "two", "6": "three", "7": "two"}, [("1", "2", "12"), ("1", "5", "12"), ("1", "7", "12"), ("2", "3", "23"), ("5", "6", "23"), ("3", "4", "34")])


def test_matchers_on_the_toy_graph():
    g, h = graph(*TOY), graph({**TOY[0], "4": "2"}, TOY[1])
    m, s = matchers.tolerant_match(g, g)
    assert s == 1.0 and all(m[n][0] in TOY[0] for n in m) and len(m) == 7
    m, s = matchers.path_match(g, g)
    assert s == 1.0 and {n: x[0] for n, x in m.items()} == {n: n for n in TOY[0]}
    assert 0 < matchers.path_match(g, h)[1] < 1 and 0 < matchers.tolerant_match(g, h)[1] < 1
    assert matchers.path_match(g, graph({"9": "zzz"}, []))[1] == 0 == matchers.tolerant_match(g, graph({"9": "zzz"}, []))[1]


def test_path_match_has_no_budget_of_trials():
    q = graph({"r": "R", **{f"a{i:02}": f"L{i}" for i in range(10)}, "z": "Z"}, [("r", "a00", "e"), ("r", "z", "e"), *[(f"a{i:02}", f"a{i + 1:02}", "e") for i in range(9)]])
    layers = [[f"a{i:02}{k}" for k in range(4)] for i in range(10)]  # 4 ** 10 ways down
    t = graph({"r": "R", "z": "Z", **{n: f"L{i}" for i, ns in enumerate(layers) for n in ns}}, [("r", "z", "e"), *[("r", n, "e") for n in layers[0]], *[(a, b, "e") for x, y in zip(layers, layers[1:]) for a in x for b in y]])
    m, s = matchers.path_match(q, t)
    assert s == 1.0 and len(m) == 12


def test_matchers_as_a_table(spark):
    nodes = df(spark, GN, *[(f, n, t, "") for f in ("q", "t") for n, t in TOY[0].items()], ("e", "1", "one", ""))
    edges = df(spark, GE, *[(f, *e) for f in ("q", "t") for e in TOY[1]])
    pairs = df(spark, "q_fn string, t_fn string", ("q", "t"), ("e", "t"), ("q", "e"))
    for how in matchers.MATCHERS:
        out = {(r.q_fn, r.t_fn): r for r in matchers.match(pairs, matchers.packed(nodes, edges), how).collect()}
        assert out["q", "t"].score == (100.0 if how == "exact" else 1.0) and len(out) == 3
        m = matchers.GraphMatcher(how)
        assert m.match(pairs, m.prepare_query(nodes, edges), m.prepare_target(nodes.where("fn_id = 't'"), edges)).count() == 2
    w = df(spark, "q_fn string, t_fn string, a string, b string, w double", ("q", "t", "1", "x", 2.0), ("q", "t", "1", "y", 1.5), ("q", "t", "2", "x", 1.8), ("q", "t", "2", "x", 0.1), ("q", "u", "1", "z", 1.0))
    assert got(matchers.assigned(w), "t_fn", "a", "b", "w") == [("t", "1", "y", 1.5), ("t", "2", "x", 1.8), ("u", "1", "z", 1.0)] and matchers.assigned(w.limit(0)).count() == 0
    chosen = df(spark, "sig_id string, side string, fn_id string, node_id string", ("s", "v", "q", "4"), ("s", "v", "q", "1"), ("s", "p", "e", "1"))
    assert got(matchers.connected(chosen, matchers.packed(nodes, edges)), "side", "node_id") == [("p", "1"), *(("v", n) for n in "1234")]


def test_connect_and_expand():
    g = graph({str(i): "t" for i in range(9)}, [(str(i), str(i + 1), "r") for i in range(7)])
    assert matchers.connect({"0", "3", "4"}, g) == {"0", "1", "2", "3", "4"} and matchers.connect({"0", "8"}, g) == {"0", "8"} and matchers.connect(set(), g) == set()
    assert matchers.expand_to({"3"}, g, 4) == {"2", "3", "4"} | {"1", "5"} and matchers.expand_to({"8"}, g, 4) == {"8"}


def test_components_trees_and_sizes(spark):
    e = df(spark, "src string, dst string", *[(f"a{i:03d}", f"a{i + 1:03d}") for i in range(40)], ("x", "y"), ("z", "z"), (None, "x"))
    comp = dict(got(graphalg.connected_components(e), "node", "component"))
    assert len(comp) == 44 and {comp[f"a{i:03d}"] for i in range(41)} == {"a000"} and comp["y"] == "x" and comp["z"] == "z"
    assert graphalg.connected_components(e.limit(0)).count() == 0
    t = graphalg.bfs_tree(df(spark, "src string, dst string", ("1", "2"), ("3", "1"), ("2", "4"), ("3", "4"), ("8", "9")), df(spark, "node string", ("1",)))
    assert sorted(tuple(r) for r in t.select("node", F.coalesce("parent", F.lit("-")), "depth").collect()) == [("1", "-", 0), ("2", "1", 1), ("3", "1", 1), ("4", "2", 2)]
    assert got(graphalg.subtree_sizes(t), "node", "size") == [("1", 4), ("2", 2), ("3", 1), ("4", 1)]


def test_node_index(spark):
    nodes, edges = df(spark, GN, *[("f", n, t, "") for n, t in TOY[0].items()]), df(spark, GE, *[("f", *e) for e in TOY[1]], ("f", "2", "5", "25"))
    ix = {r.node_id: r for r in structure.neighbourhood_index(nodes, edges).collect()}
    assert (ix["1"].degree, ix["1"].labels, ix["1"].links) == (3, ["two"], 0) and ix["2"].degree == 3 and ix["4"].labels == []
    assert got(structure.important_nodes(structure.neighbourhood_index(nodes, edges), 0.3), "node_id") == [("2",), ("5",)]
    d = {r.node_id: r for r in structure.direction_index(nodes, edges).collect()}
    assert (d["5"].in_deg, d["5"].out_deg, d["5"].in_labels, d["5"].out_rels) == (2, 1, ["one", "two"], ["23"])
    pat = structure.edge_pattern(nodes, edges, [("a", "12", "b"), ("b", "23", "c")], {"a": "one", "b": "two", "c": "three"})
    assert got(pat, "a", "b", "c") == [("1", "2", "3"), ("1", "5", "6")]


def test_readers_and_writers(spark, tmp_path):
    d = tmp_path / "p" / "r" / "CVE-1" / "vuln" / "ab_1" / "x.c"
    d.mkdir(parents=True)
    (d / "nodes.csv").write_text("command\tkey\ttype\tcode\tlocation\tfunctionId\nA\t1\tFile\tx.c\t\t\nA\t2\tFunction\tfoo\t1:0:0:9\t\nA\t3\tSymbol\tx\t\t2\nbad\nA\t4\tCallee\t\"a\tb\"\t\t2\n")
    (d / "edges.csv").write_text("start\tend\ttype\n3\t4\tUSE\n3\t9\tUSE\n")
    rows = readers.node_rows(spark, str(tmp_path)).where("reason is null").withColumnRenamed("nodes_path", "file_id")
    nodes = ingest.sessionize(rows, order="line_no")
    edges = ingest.attach_edges(nodes, readers.edge_rows(spark, str(tmp_path)))
    assert got(nodes, "func", "key", "code") == [("foo", "3", "x"), ("foo", "4", "a\tb")] and got(edges, "src", "dst", "rel") == [("3", "4", "USE")]
    (tmp_path / "l.txt").write_text("TP CVE-1 a/b\nFP CVE-1 a\nodd\n")
    (tmp_path / "repos").write_text("a  http://x\n\nb\n")
    assert got(readers.manual_labels(spark, str(tmp_path / "l.txt")), "*") == [(1, "TP", "CVE-1", "a/b"), (2, "FP", "CVE-1", "a")]
    assert readers.manual_labels(spark, None).count() == 0 and got(readers.repo_list(spark, str(tmp_path / "repos")), "*") == [("a", "http://x")]
    names = tmp_path / "f" / "r" / "CVE-1"
    names.mkdir(parents=True)
    (names / "funcnames").write_text("foo \n\nbar\nfoo\n")
    assert got(readers.function_names(spark, str(tmp_path / "f")), "*") == [("r", "CVE-1", "bar"), ("r", "CVE-1", "foo")]
    writers.modifications(df(spark, "path string, added int, clone_type int, verdict string", ("a/b", 1, 2, "TP")), str(tmp_path / "mods"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "mods")).collect()] == ["a/b 1 2 TP"]
    cached = str(tmp_path / "once")
    assert writers.once(spark.range(3), cached).count() == 3 == writers.once(spark.range(5), cached).count()
    src = df(spark, "file string, content string", ("x.c", "0123456789é!"))
    assert got(readers.functions_of(src, df(spark, "file string, func string, location string", ("x.c", "g", "1:0:9:10"))), "code") == [("9é",)]


def test_streaming_scores_each_batch_once(spark, tmp_path):
    from triloom.streaming.scoring import SCHEMA, watch

    _, parts = parts_of(spark, ["1", "2", "3"], ["2", "3", "4"])
    parts = parts.cache()
    put = lambda f, ts: df(spark, SCHEMA, *[("r", f, t, "r", "b") for t in ts]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for f, ts in (("hit", ["1", "2", "3"]), ("miss", ["4", "2", "3"])):
        put(f, ts)
        watch(spark, str(tmp_path / "in"), parts, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    put("late", ["1", "2"])
    watch(spark, str(tmp_path / "in"), parts, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert got(spark.read.parquet(str(tmp_path / "out")), "target_id") == [("hit",)]


def test_streaming_scores_targets_that_arrive_in_parts(spark, tmp_path):
    from triloom.streaming.scoring import SCHEMA, current, watch

    _, parts = parts_of(spark, ["1", "2", "3", "5"], ["2", "3", "4", "5"])
    parts = parts.cache()
    at = lambda x: str(tmp_path / x)
    for rows in ([("t", "1"), ("t", "2"), ("u", "9")], [("t", "3"), ("w", "1")], [("t", "4"), ("w", "2"), ("w", "5"), (None, "1")]):
        df(spark, SCHEMA, *[("r", f, x, "r", "b") for f, x in rows]).coalesce(1).write.mode("append").parquet(at("in"))
        watch(spark, at("in"), parts, at("out"), at("ck"), once=True).awaitTermination(120)
    # t was a hit with three triples, and is none any more now that it has what the fix added
    assert got(spark.read.parquet(at("out")), "target_id") == [("t",), ("w",)] and got(current(spark, at("out")), "target_id", "cvg") == [("w", pytest.approx(200 / 3))]


def parser_files(folder, nodes, edges):
    folder.mkdir(parents=True)
    (folder / "nodes.csv").write_text("command\tkey\ttype\tcode\tlocation\tfunctionId\n" + "".join("\t".join(["ANR", *n]) + "\n" for n in nodes))
    (folder / "edges.csv").write_text("start\tend\ttype\n" + "".join("\t".join(e) + "\n" for e in edges))


def test_from_parser_output_to_hits(spark, tmp_path, capsys):
    src, parsed, out = tmp_path / "src", tmp_path / "parsed", tmp_path / "db"
    node = lambda k, kind, code, fn: (k, kind, code, "", fn)
    fn = lambda k, name, at: (k, "Function", name, at, "")
    def version(cve, role, body, extra=()):
        place = f"r/{cve}/{role}/ab_5/x.c"
        rows = [fn("1", "foo", "1:0:0:3"), *[node(str(10 + i), "Symbol", c, "1") for i, c in enumerate(body)], ("99", "BadType", "", "", ""), fn("2", "bar", "2:0:4:7"), node("30", "Callee", "z", "2")]
        parser_files(parsed / place, rows, [(str(10 + i), str(11 + i), "USE") for i in range(len(body) - 1)] + [("10", "30", "USE"), *extra])
        (src / place).parent.mkdir(parents=True)
        (src / place).write_text("foo;bar;")
    version("C-1", "vuln", ["a", "b", "c"])
    version("C-1", "patch", ["a", "b", "d"])
    version("C-2", "vuln", ["a", "b"])  # no fixed file
    (src / "r/C-1/funcnames").write_text("foo\n\n")
    (src / "r/C-2/funcnames").write_text("foo\n")
    cli.ingestion(spark, str(parsed), str(out), str(src))
    db = readers.graph_db(spark, str(out))
    assert sorted((r.role, r.func, r.code, r.ext) for r in db["funcs"].collect()) == [("patch", "foo", "foo;", "c"), ("vuln", "foo", "foo;", "c")]
    assert db["nodes"].count() == 6 and db["edges"].count() == 4 and db["vectors"].count() == 2
    assert got(spark.read.parquet(f"{out}/rejects"), "reason") == [("type",)] * 3
    cli.ingestion(spark, str(parsed), f"{tmp_path}/all")
    every = readers.graph_db(spark, f"{tmp_path}/all")
    assert every["funcs"].count() == 6 and sorted((r.n_functions, r.n_edges, r.n_kept) for r in spark.read.parquet(f"{tmp_path}/all/counts").collect()) == [(2, 2, 1), (2, 3, 2), (2, 3, 2)]
    v, p = (db["funcs"].where(F.col("role") == role).first().fn_id for role in ("vuln", "patch"))
    cli.pair(spark, str(out), v, p, f"{tmp_path}/one")
    cli.signatures(spark, str(out), f"{tmp_path}/sig")
    for at in ("one", "sig"):
        sig, parts, _ = readers.signature_db(spark, f"{tmp_path}/{at}")
        assert sig.count() == 1 and got(parts.where("part = 'pvg'"), "a", "b") == [("Symbol", "c"), ("b", "c")]
    capsys.readouterr()
    cli.ad_hoc(spark, f"{tmp_path}/one", str(out), v)
    said = capsys.readouterr().out.split("\n")
    assert said[0].endswith(" 100.0 100.0 0.0") and said[0].startswith("exact") and said[1].startswith("approximate")
    parts.where("part <> 'nvg'").write.parquet(f"{tmp_path}/torn/sig_parts")
    for t in ("sig", "sig_vec"):
        spark.read.parquet(f"{tmp_path}/sig/{t}").write.parquet(f"{tmp_path}/torn/{t}")
    with pytest.raises(ValueError, match="incomplete"):
        readers.signature_db(spark, f"{tmp_path}/torn")


def test_functions_of_one_name_and_without_nodes(spark):
    rows = df(spark, "file_id string, line_no int, key string, type string, code string, location string, function_id string", ("x", 2, "1", "Function", "f", "a", ""), ("x", 3, "5", "A", "old", "", ""), ("x", 4, "2", "Function", "f", "b", ""), ("x", 5, "5", "A", "p", "", ""), ("x", 6, "5", "A", "q", "", ""), ("x", 7, "3", "Function", "g", "c", ""))
    edges = df(spark, "file_id string, src string, dst string, rel string", ("x", "5", "5", "r"), ("x", "5", "5", "r"), ("x", "5", "1", "r"))
    functions, nodes, links = ingest.graphs(rows, edges)
    assert got(functions, "fn_id", "location") == [("x#f", "b"), ("x#g", "c")] and got(nodes, "node_id", "code") == [("5", "q")] and links.count() == 2
    none = ingest.graphs(rows.limit(0), edges)
    assert [x.count() for x in none] == [0, 0, 0]


def test_mining_from_files(spark, tmp_path):
    import json as j

    (tmp_path / "diffs" / "r").mkdir(parents=True)
    for h in ("h1", "h2", "h3"):
        (tmp_path / "diffs" / "r" / f"{h}.diff").write_text("fix CVE-2001-1\n" + (DIFF if h != "h1" else "diff --git a/x.h b/x.h"))
    commit = lambda i, m, message: {"repo": "r", "seq": i, "hash": f"h{i}", "author_ts": i, "message": message, "is_merge": m, "parents": []}
    (tmp_path / "log.json").write_text("\n".join(j.dumps(x) for x in (commit(1, False, "CVE-2001-1"), commit(2, False, "CVE-2001-1"), commit(3, False, "CVE-2001-1"), commit(4, True, "CVE-2001-1"))))
    df(spark, "blob_id string, content string", ("12ab", "old"), ("34cd", "new"), ("3", "x"), ("4", "y")).write.parquet(f"{tmp_path}/blobs")
    cli.mine(spark, f"{tmp_path}/log.json", f"{tmp_path}/diffs", f"{tmp_path}/blobs", f"{tmp_path}/out")
    assert sorted(map(str, got_rows(spark.read.parquet(f"{tmp_path}/out/mined"), "hash", "reason"))) == ["('h1', 'no function')", "('h2', None)", "('h3', 'CVE covered already')"]
    assert got(spark.read.parquet(f"{tmp_path}/out/src"), "role", "hsh", "content") == [("patch", "h2_2", "new"), ("patch", "h2_2", "y"), ("vuln", "h2_2", "old"), ("vuln", "h2_2", "x")]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/names").collect()) == ["bar", "baz", "late"]
    cli.mine(spark, f"{tmp_path}/log.json", f"{tmp_path}/diffs", f"{tmp_path}/blobs", f"{tmp_path}/again", f"{tmp_path}/out")
    assert got(spark.read.parquet(f"{tmp_path}/again/counters"), "*") == [("r", 0, 3)]


def test_rates_as_text(spark):
    counts = df(spark, "slice string, tp long, fp long, tn long, fn long, unk long", ("m", 6, 2, 0, 2, 2), ("z", 0, 0, 0, 0, 0))
    assert [r.value for r in evaluate.rate_lines(evaluate.rates(counts)).collect()][:4] == ["m nominal 0.750000 0.750000 0.750000", "m worst 0.600000 0.750000 0.666667", "m best 0.800000 0.800000 0.800000", "z nominal - - -"]


def test_addresses():
    from triloom.session import address

    assert [address(x) for x in ("file:/a/b", "file:///a", "/a", "s3a://b/k", "hdfs://h:1/x")] == ["file:///a/b", "file:///a", "/a", "s3://b/k", "hdfs://h:1/x"]


def test_no_folder_of_our_own_on_a_cluster():
    from types import SimpleNamespace

    from triloom import session

    for master, fails in (("yarn", True), ("spark://h:7077", True), ("local-cluster[3,2,1024]", True), ("local[4]", False)):
        made = []
        sc = SimpleNamespace(applicationId=f"app-{master}", master=master, setCheckpointDir=made.append, getCheckpointDir=lambda: None)
        try:
            session.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
        except RuntimeError:
            assert fails and not made
        except AttributeError:  # beyond the check there is no JVM here
            assert not fails and made
