"""Later versions along the ancestry: what a look-up costs doesn't grow with the versions below a root."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triloom.operators import history

from tests.test_postings import moved

COMMITS = "repo string, hash string, ts long, seq long, parents array<string>, paths array<string>"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string())]


def test_no_row_for_a_pair_of_a_root_and_a_later_version(spark):
    n = 2_000
    commits = spark.createDataFrame([("r", str(i), i, i, [str(i - 1)] if i else [], ["p"]) for i in range(n)], COMMITS)
    out = []
    made = moved(spark, lambda: out.extend(history.versions_along(commits, commits.select("repo", "hash", F.lit("p").alias("path"))).collect()))
    assert made < 30 * n  # with a row for each pair there would be n ** 2 / 2
    assert {(int(r.hash), r.after, r.after_1mo, r.after_6mo) for r in out} == {(i, str(i + 1) if i < n - 1 else None, None, None) for i in range(n)}


@pytest.mark.parametrize("skew", [0, 5, 200])
@pytest.mark.parametrize("few, gaps", [(3, (30, 180)), (1, ())])
def test_nearest_versions_are_those_of_all_pairs(monkeypatch, skew, few, gaps):
    monkeypatch.setattr(history, "TIDY", 7)
    r = random.Random(skew + few)
    for trial in range(25):
        n = 150
        parents = {i: sorted({r.choice(range(max(0, i - 6), i)) for _ in range(r.choice([1, 1, 2]))}) if i and r.random() > 0.05 else [] for i in range(n)}
        ts = {i: None if r.random() < 0.02 else i * 4 + r.randint(-skew, skew) for i in range(n)}
        paths = {i: r.sample("pqs", r.randint(0, 2)) for i in range(n)}
        wanted = {i: r.sample("pqs", r.randint(0, 2)) for i in range(n)}
        below = {i: set() for i in range(n)}
        for i in reversed(range(n)):
            for p in parents[i]:
                below[p] |= below[i] | {i}
        key = lambda i: (ts[i] is not None, ts[i] or 0, i, str(i))
        rows = [("r", str(i), ts[i], i, paths[i], [str(p) for p in parents[i]], sum(i in parents[c] for c in range(n)), wanted[i]) for i in sorted(range(n), key=key)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 40]), KINDS)], [f"c{j}" for j in range(8)]) for k in range(0, n, 40)]
        got = [x for b in history._later(few, gaps)(iter(batches)) for x in zip(*(b.column(k).to_pylist() for k in range(4 + len(gaps))))]
        want = []
        for i in range(n):
            for p in wanted[i]:
                new = sorted((x for x in below[i] if p in paths[x]), key=key)
                near = [[x for x in new if ts[x] is not None and ts[i] is not None and ts[x] <= ts[i] + g] for g in gaps]
                want.append(("r", p, str(i), [str(x) for x in new[:few]], *[str(x[-1]) if x else None for x in near]))
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_commits_among_their_own_ancestors_end():
    rows = [("r", "a", 1, 1, ["p"], ["b"], 1, ["p"]), ("r", "b", 2, 2, ["p"], ["a"], 1, ["p"])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], [f"c{j}" for j in range(8)])
    assert sum(b.num_rows for b in history._later(1, ())(iter([batch]))) == 2
