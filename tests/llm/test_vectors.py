import numpy as np

from triloom.llm.hnsw import Hnsw
from triloom.llm.vectors import nearest_neighbours, neighbour_pairs

SCHEMA = "fn_id string, vec array<bigint>"


def brute(rows, k=5):
    names, x = [n for n, _ in rows], np.array([v for _, v in rows])
    out = {}
    for i, n in enumerate(names):
        d = ((x - x[i]) ** 2).sum(1)
        out[n] = [names[j] for j in sorted((j for j in range(len(names)) if j != i), key=lambda j: (d[j], names[j]))[:k]]
    return out


def clustered(n, dim, seed=0):
    r = np.random.default_rng(seed)
    centres = r.poisson(20, (max(2, n // 50), dim))
    return np.maximum(0, centres[r.integers(0, len(centres), n)] + r.integers(-3, 4, (n, dim)))


def test_small_tables_are_exact(spark):
    x = clustered(300, 9)
    x[50:70] = x[10]  # more copies than neighbours
    rows = [(f"f{i:04d}", v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), dim=9).collect():
        got.setdefault(r.fn_id, {})[r["rank"]] = r.neighbour
    assert {f: [v[i] for i in sorted(v)] for f, v in got.items()} == brute(rows)


def test_recall_over_many_shards(spark):
    x = clustered(6000, 16, 3)
    rows = [(f"f{i:05d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.fn_a, r.fn_b) for r in neighbour_pairs(nearest_neighbours(df, dim=16, leaf_rows=700)).collect()}
    want = {(min(a, b), max(a, b)) for a, bs in brute(rows).items() for b in bs}
    assert len(got & want) / len(want) >= 0.95


def test_no_leaf_that_may_hold_a_neighbour_is_left_out(spark):
    r = np.random.default_rng(4)
    x = r.integers(0, 40, (6000, 16))  # no clusters: neighbours lie in many leaves
    rows = [(f"f{i:05d}", v.tolist()) for i, v in enumerate(x)]
    got = {(n.fn_id, n.neighbour) for n in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), dim=16, leaf_rows=100).collect()}
    want = {(a, b) for a, bs in brute(rows).items() for b in bs}
    assert len(got & want) / len(want) >= 0.99  # 64 leaves


def test_bad_rows_ties_and_small_tables(spark):
    rows = [("a", [0, 0]), ("b", [1, 0]), ("c", [0, 1]), ("a", [0, 0]), ("n", None), ("s", [1]), ("l", [1, 2, 3]), ("h", [None, 1]), (None, [0, 0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cid int, fn string")
    got = sorted((r.fn_id, r.neighbour, r.d2, r["rank"]) for r in nearest_neighbours(df, dim=2, k=2).collect())
    assert got == [("a", "b", 1, 1), ("a", "c", 1, 2), ("b", "a", 1, 1), ("b", "c", 2, 2), ("c", "a", 1, 1), ("c", "b", 2, 2)]
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), dim=2).count() == 0
    assert nearest_neighbours(spark.createDataFrame(rows[:1], SCHEMA), dim=2).count() == 0


def test_a_third_of_all_vectors_equal(spark):
    rows = [(f"f{i:04d}", [7, 7] if i % 3 == 0 else [i, 2 * i]) for i in range(300)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, SCHEMA), dim=2).collect():
        got.setdefault(r.fn_id, {})[r["rank"]] = r.neighbour
    assert {f: [v[i] for i in sorted(v)] for f, v in got.items()} == brute(rows)


def test_graph_recall():
    x = clustered(3000, 24, 7)
    ids, d = Hnsw(x).search(x[:400], 6, 48)
    true = np.argsort(((x[:400, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, true)]) > 0.97
    for n in (0, 1, 2, 5):
        ids, d = Hnsw(x[:n]).search(x[:3], 6, 16)
        assert (ids >= 0).sum() == 3 * n


def test_vectors_as_bytes_keep_every_number():
    from triloom.llm.vectors import _numbers, _packed

    x = np.array([[0, -1, 32767], [32768, 5, -7], [-(1 << 31), 1, 2], [(1 << 62), -(1 << 62), 3], [-(1 << 63), 0, 1]], np.int64)
    raw = _packed(x)
    assert [len(v) for v in raw.to_pylist()] == [6, 12, 12, 24, 24] and (_numbers(raw, 3) == x).all()
    assert _numbers(_packed(x[:0]), 3).shape == (0, 3)
