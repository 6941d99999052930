"""Near duplicates and overlap across splits, against comparing all pairs."""

import random
from itertools import combinations

import pytest

from triloom.llm import neardup, overlap, sets

SCHEMA = "fn_id string, a string, rel string, b string"


def family(r, n, size, base=""):
    """Sets around a few originals, some equal, some with edits of any extent."""
    out = {}
    common = [("T", "U", f"c{i}") for i in range(12)]
    for i in range(n):
        if out and r.random() < 0.7:
            old = r.choice(sorted(out))
            s = set(out[old])
            for _ in range(r.choice([0, 0, 1, 1, 2, size // 8, size // 5, size // 3])):
                if s and r.random() < 0.5:
                    s.discard(r.choice(sorted(s)))
                else:
                    s.add((f"n{r.random()}", "R", "x"))
        else:
            k = max(1, int(r.gauss(size, size / 3)))
            s = {(f"w{r.random()}", "R", "x") for _ in range(k)} | set(r.sample(common, r.randint(0, 12)))
        out[f"{base}f{i:04d}"] = s or {("T", "U", "c0")}
    return out


def rows_of(fam, r):
    rows = [(f, *t) for f, s in fam.items() for t in s]
    rows += r.sample(rows, len(rows) // 10) + [(f, None, "R", "x") for f in list(fam)[:5]] + [("none", None, "R", "x"), (None, "a", "b", "c")]
    r.shuffle(rows)
    return rows


def brute(fam, t):
    return sorted((a, b) for a, b in combinations(sorted(fam), 2) if len(fam[a] & fam[b]) >= t * len(fam[a] | fam[b]) - 1e-12)


@pytest.mark.parametrize("size", [1, 3, 8, 40, 150])
@pytest.mark.parametrize("t", [0.7, 0.9])
def test_all_pairs_are_found(spark, size, t):
    r = random.Random(size)
    fam = family(r, 120, size)
    got = neardup.near_duplicates(spark.createDataFrame(rows_of(fam, r), SCHEMA), t=t).collect()
    assert sorted(map(tuple, got)) == brute(fam, t)


@pytest.mark.parametrize("t", [0.5, 0.7, 0.9])
def test_small_sets_of_few_tokens(spark, t):
    """Often more parts are empty than may be left out."""
    r = random.Random(11)
    fam = {f"f{i:03d}": {("w", "r", str(k)) for k in r.sample(range(11), r.randint(1, 8))} for i in range(400)}
    got = neardup.near_duplicates(spark.createDataFrame([(f, *x) for f, s in fam.items() for x in s], SCHEMA), t=t).collect()
    assert sorted(map(tuple, got)) == brute(fam, t)


def test_sets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sets, "BIG", 20)
    r = random.Random(5)
    fam = family(r, 60, 60)
    df = spark.createDataFrame(rows_of(fam, r), SCHEMA)
    assert sets.token_sets(df, "fn_id", ("a", "rel", "b")).where("bits > 0").count() > 0
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == brute(fam, 0.7)
    roles = {f: r.choice(["vuln", "patch", "before", "after"]) for f in fam}
    funcs = spark.createDataFrame([(f, "repo", f"/d/repo/CVE-1-1/{x}/abcdef0_1/f.c/graph/g.gpickle") for f, x in roles.items()], "fn_id string, repo string, path string")
    got = overlap.cross_split(df, funcs)[0]
    side = {f: x in ("vuln", "patch") for f, x in roles.items()}
    assert sorted((x.fn_a, x.fn_b) for x in got.collect()) == [p for p in brute(fam, 0.9) if side[p[0]] != side[p[1]]]


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(none).count() == 0 and neardup.near_duplicate_groups(none).count() == 0
    rows = [("x", "a", "r", "b", 1, "id"), ("y", "a", "r", "b", 2, "id"), ("y", "a", "r", "b", 2, "id"), ("z", "", "", "", 1, None), ("w", "", "", "", 1, "q" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA + ", h int, rec string")
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == [("w", "z"), ("x", "y")]


def test_groups(spark):
    base = {("t", "r", str(i)) for i in range(20)}
    chain = {f"c{k}": {("t", "r", str(i)) for i in range(k, 20 + k)} for k in range(0, 13, 3)}
    fam = {"a": base, "b": base, **chain, "z": {("q", "q", "q")}}
    df = spark.createDataFrame([(f, *t) for f, s in fam.items() for t in s], SCHEMA)
    got = {r.fn_id: (r.class_rep, r.n_copies, r.n_links, r.group_rep) for r in neardup.near_duplicate_groups(df).collect()}
    assert got["a"] == got["b"] == ("a", 3, 1, "a") and got["c0"] == ("a", 3, 1, "a")
    assert got["c12"] == ("c12", 1, 1, "a") and got["c3"] == ("c3", 1, 2, "a") and got["z"] == ("z", 1, 0, "z")


def test_a_third_of_all_records_equal(spark):
    fam = {f"f{i:03d}": {("same", "r", str(k)) for k in range(10)} if i % 3 == 0 else {(f"w{i}", "r", str(k)) for k in range(10)} for i in range(90)}
    df = spark.createDataFrame([(f, *t) for f, s in fam.items() for t in s], SCHEMA)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == brute(fam, 0.7)
    assert neardup.near_duplicate_groups(df).where("n_copies = 30").count() == 30


@pytest.mark.parametrize("size", [1, 4, 25, 120])
def test_overlap_across_splits(spark, size):
    r = random.Random(size)
    fam = family(r, 140, size)
    roles = {f: r.choice(["vuln", "patch", "before", "after", "else"]) for f in fam}
    funcs = [(f, f"repo{i % 3}", f"/x/before/repo/CVE-1-1/{x}/abcdef0_1/f.c/graph/g.gpickle") for i, (f, x) in enumerate(roles.items())]
    funcs += funcs[:10] + [("f0000", "repo0", None), (None, None, "a/b")]
    df, fu = spark.createDataFrame(rows_of(fam, r), SCHEMA), spark.createDataFrame(funcs, "fn_id string, repo string, path string")
    pairs, over = overlap.cross_split(df, fu)
    split = {f: {"vuln": 0, "patch": 0, "before": 1, "after": 1}.get(x) for f, x in roles.items()}
    want = [(a, b) for a, b in brute(fam, 0.9) if {split[a], split[b]} == {0, 1}]
    assert sorted((x.fn_a, x.fn_b) for x in pairs.collect()) == want
    for o in over.collect():
        assert o.both == len(fam[o.fn_a] & fam[o.fn_b]) and 0 <= o.overlap_a <= o.both / o.n_a + 1e-9
    report = {(x.split, x.repo): (x.n_records, x.n_pairs) for x in overlap.overlap_report(overlap.alike(df, fu), fu).collect()}
    assert sum(n for (side, _), (_, n) in report.items() if side == "train") == len(want)
    repo = {f: f"repo{i % 3}" for i, f in enumerate(roles)}
    ends = [x for p in want for x in p]
    assert report == {(("train", "eval")[k], q): (len({x for x in ends if split[x] == k and repo[x] == q}), sum(split[x] == k and repo[x] == q for x in ends)) for k, q in {(split[x], repo[x]) for x in ends}}


def test_a_record_of_both_splits_is_no_partner_of_itself(spark):
    df = spark.createDataFrame([(f, "a", "r", str(k)) for f in ("x", "y") for k in range(20)], SCHEMA)
    at = lambda f, role, repo: (f, repo, f"/d/r/C/{role}/abcdef0_1/f.c/graph/g.gpickle")
    fu = spark.createDataFrame([at("x", "vuln", "p"), at("x", "after", "p"), at("y", "vuln", "q")], "fn_id string, repo string, path string")
    assert sorted(tuple(r) for r in overlap.overlap_report(overlap.alike(df, fu), fu).collect()) == [("eval", "p", 1, 1), ("train", "q", 1, 1)]


@pytest.mark.parametrize("t", [0.6, 0.7, 0.8, 0.95])
def test_small_sets_share_no_word_unless_alike(spark, t):
    r = random.Random(7)
    fam = {f"f{i:03d}": {("w", "r", str(k)) for k in (0, 1, 2)} | {("u", "r", str(k)) for k in r.sample(range(60), r.randint(0, 11))} for i in range(500)}
    df = spark.createDataFrame([(f, *x) for f, s in fam.items() for x in s], SCHEMA)
    assert sorted(map(tuple, neardup.near_duplicates(df, t=t).collect())) == brute(fam, t)
    members, reps = sets.classes(sets.token_sets(df, "fn_id", ("a", "rel", "b")))
    words = reps.transform(neardup.arrow, neardup._small_keys(t), "grp int, key long, id long, bits int, n long, home boolean, guest boolean").collect()
    rep = {m.rep: fam[m.rec] for m in members.collect()}
    met = {}
    for x in words:
        met.setdefault((x.grp, x.key), []).append(x)
    pairs = [(rep[a.id], rep[b.id]) for group in met.values() for a in group for b in group if a.home and b.guest and a.id != b.id]
    assert (pairs or t > 0.9) and all(len(a & b) >= t * len(a | b) - 1e-9 for a, b in pairs)


def test_overlap_of_empty_tables(spark):
    fu = spark.createDataFrame([], "fn_id string, repo string, path string")
    pairs, over = overlap.cross_split(spark.createDataFrame([], SCHEMA), fu)
    assert pairs.count() == 0 and over.count() == 0


def test_roles(spark):
    from pyspark.sql import functions as F

    paths = {"data/r/CVE/vuln/ab12_99/f.c/graph/x.gpickle": "vuln", "\\srv\\before\\r\\c\\after\\\\ab_1\\f\\graph\\g": "after", "/before/a_1/patch/ff00ff0_12/f/graph/g": "patch", "a/b": None, "vuln/abcdef01_5": "vuln", "": None}
    df = spark.createDataFrame(list(paths.items()), "path string, want string")
    assert all(r[0] == r[1] for r in df.select(overlap.role_of(F.col("path")), "want").collect())
