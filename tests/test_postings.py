"""Pairs of signatures and targets: what moves grows with the rows that are read, not with pairs times triples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triloom.operators import dense, match, postings
from triloom.plans import core

QUERIES = core.queries()
TR = "fn_id string, a string, rel string, b string"
PT = "sig_id string, part string, a string, rel string, b string"


def moved(spark, run):
    """Rows that go through shuffles."""
    store, jvm, gw = spark.sparkContext._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def upto():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gw.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = upto()
    run()
    return sum(n for k, n in upto().items() if k not in before)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """40 fixed functions and 120 later versions of them, all of the same 30 triples but one."""
    at = str(tmp_path_factory.mktemp("alike"))
    fn = lambda i, cve, role: (i, "r", cve, f"d/r/{cve}/{role}/h_1/f.c/graph/g.gpickle", f"{i}\n", None)
    fns = [fn(f"{r}{i}", f"C-{i % 40}", role) for r, role, n in (("v", "vuln", 40), ("p", "patch", 40), ("b", "before", 120)) for i in range(n)]
    spark.createDataFrame(fns, "fn_id string, repo string, cve string, path string, code string, loaded_at timestamp").write.parquet(f"{at}/funcs.parquet")
    rows = [(f[0], f"x{i}", "r", "y") for f in fns for i in range(30)] + [(f[0], "new" if f[0][0] == "p" else "old", "r", "y") for f in fns]
    spark.createDataFrame(rows, TR).write.parquet(f"{at}/triples.parquet")
    return at, len(rows)


@pytest.mark.parametrize("name", ["hits_eval", "hits_scan", "hit_file", "hits_pruned", "verdicts", "eval_slices", "rate_lines", "eval_test_modified", "eval_zero_safe", "store_mods"])
def test_no_row_for_a_triple_that_a_pair_shares(spark, alike, name):
    at, n = alike
    less_moved(spark, at, name, 15 * n)  # all 8,000 pairs are hits, and those go through joins; with a row for each triple there would be 40 n


@pytest.mark.parametrize("name", ["score_exact", "score_file", "threshold_grid"])
def test_a_target_moves_once_whatever_the_number_of_blocks(spark, alike, name, monkeypatch):
    at, n = alike
    monkeypatch.setattr(dense, "SIG_BLOCK", 60)
    less_moved(spark, at, name, 3 * n)


def less_moved(spark, at, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if no side were small
    try:
        assert moved(spark, lambda: QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()) < most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bounded_hits_are_those_of_all_scores_whatever_the_blocks(spark, monkeypatch):
    r = random.Random(4)
    tr = spark.createDataFrame([(f"f{i}", str(r.randint(0, 11)), "r", r.choice("xy")) for i in range(60) for _ in range(r.randint(1, 14))] + [(None, "1", "r", "x"), ("f1", None, "r", "x")], TR).cache()
    parts = spark.createDataFrame(list({(f"s{i}", p, str(r.randint(0, 12)), "r", r.choice("xy")) for i in range(25) for p in match.PARTS for _ in range(r.randint(1, 5))}) + [("s1", "cvg", None, "r", "x")], PT).cache()
    c = [F.col(x) for x in match.PARTS]
    rows = lambda f: sorted(map(tuple, f.select("sig_id", "target_id", *match.PARTS).collect()))
    every = match.score_exact(parts, tr)
    want = [rows(every.where(f(*c))) for f in (match.is_scan_hit, match.is_eval_hit)]
    assert all(want)
    for size in (1_000_000, 20):
        monkeypatch.setattr(postings, "BLOCK", size)
        monkeypatch.setattr(postings, "CHUNK", size)
        assert [rows(match.hits_scan(parts, tr)), rows(match.hits_eval(parts, tr))] == want == [rows(match.hits_scan(parts, tr, by="pvg")), want[1]]
        assert rows(postings.scores(parts, tr)) == rows(every)


def test_keys_that_agree_in_their_first_half_are_kept_apart():
    import pyarrow as pa

    t = pa.table({"sig_id": ["s", "s", "s"], "label": ["s", "s", "s"], "part": pa.array([0, 1, 2], pa.int32()), "k1": pa.array([7, 7, 9], pa.int64()), "k2": pa.array([1, 2, 1], pa.int32())})
    block = postings._Block(t)
    assert list(block.found(np.array([7, 7, 7, 9, 9, 3]), np.array([2, 1, 3, 1, 2, 1]))) == [1, 0, 3, 2, 3, 3]


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_rows_of_a_signature_stand_together_for_many_targets(monkeypatch, most):
    import pyarrow as pa

    monkeypatch.setattr(postings, "ROWS", 25, raising=False)
    monkeypatch.setattr(postings, "MOST", most, raising=False)
    names = [f"s{i:02}" for i in range(21)]
    block = postings._Block(pa.table({"sig_id": names, "label": names, "part": pa.array([0] * 21, pa.int32()), "k1": pa.array(range(21), pa.int64()), "k2": pa.array(range(21), pa.int32())}))
    one = lambda t, sig: (np.full(len(sig), t), sig, np.c_[np.ones(len(sig), int), np.zeros((len(sig), 2), int)])
    pairs = [one(t, np.array([i for i in range(21) if (i + t) % 5])) for t in range(50) if t != 7]
    got = list(postings._rows(None, None)(block, pa.array([f"t{i:02}" for i in range(50)]), iter(pairs)))
    rows = [tuple(x.values()) for b in got for x in b.to_pylist()]
    want = [(f"s{i:02}", f"t{w[0]:02}", 100.0, None, None) for w, sig, _ in pairs for i in sig]
    assert sorted(rows, key=str) == sorted(want, key=str) and max(b.num_rows for b in got) == 25
    if most > len(rows):
        assert rows == sorted(want, key=lambda x: (int(x[1][1:]) // 16, x[0], x[1]))
    # nothing to keep, and nothing at all
    assert not list(postings._rows(lambda c, p, n: c < 0, 0.0)(block, pa.array(["t"]), iter([one(0, np.arange(21))] * 3)))
    assert not list(postings._rows(None, None)(block, pa.array(["t"]), iter([])))


def test_score_files_repeat_names_where_a_codec_finds_them(spark, tmp_path):
    r = random.Random(3)
    name = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    parts = spark.createDataFrame([(f"s{i}", p, "x", "r", "y") for i in range(1000) for p in match.PARTS], PT)
    tr = spark.createDataFrame([(f"f{i}", "x", "r", "y") for i in range(64)], TR)
    names, paths = [(f"s{i}", name(90)) for i in range(1000)], [(f"f{i}", name(140)) for i in range(64)]
    scores = dense.score_exact(parts, tr, spark.createDataFrame(names, "sig_id string, name string"), spark.createDataFrame(paths, "fn_id string, path string"))
    match.named_lines(scores).write.parquet(f"{tmp_path}/lines")
    lines = {x.value for x in spark.read.parquet(f"{tmp_path}/lines").collect()}
    assert lines == {f"{n} {p} 100 100 100" for _, n in names for _, p in paths}
    assert sum(x.stat().st_size for x in tmp_path.glob("lines/*.parquet")) < 50 * len(lines)
