import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from triloom.llm import frequency
from triloom.llm.frequency import _containers, _decode, _encode, _unite, term_frequency

SCHEMA = "fn_id string, a string, b string"


def brute(rows, empty=True):
    n, recs = Counter(), defaultdict(set)
    for f, *slots in rows:
        for s in slots:
            if f is not None and s is not None and (empty or s):
                n[s] += 1
                recs[s].add(f)
    total = len({r[0] for r in rows if r[0] is not None})
    return sorted((t, n[t], len(recs[t]), "rare" if len(recs[t]) <= 2 else "common" if 4 * len(recs[t]) > total else None) for t in n)


def run(spark, rows, schema=SCHEMA, **kw):
    return sorted(tuple(r) for r in term_frequency(spark.createDataFrame(rows, schema), "fn_id", ["a", "b"], **kw).select("term", "n_occurrences", "n_records", "mark").collect())


def test_against_counting(spark, monkeypatch):
    monkeypatch.setattr(frequency, "FLUSH", 500)
    r = random.Random(1)
    terms = ["T", "t", " t", "", "é", None] + [f"w{i}" for i in range(60)]
    rows = [(r.choice([None, *[f"f{i}" for i in range(80)]]), r.choice(terms[:12] if r.random() < 0.7 else terms), r.choice(terms)) for _ in range(3000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, empty=False) == brute(rows, False)


def test_empty_tables_nulls_and_extra_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, "x", "y"), ("f", None, None)]) == []
    rows = [("f", "x", "x"), ("f", "x", "x"), ("g", "y" * 200_000, "x")]
    got = term_frequency(spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", term string, no int"), "fn_id", ["a", "b"])
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_a_record_with_a_third_of_all_rows(spark):
    rows = [("hot" if i % 3 == 0 else f"f{i}", f"t{i % 7}", f"u{i}") for i in range(6000)]
    assert run(spark, rows) == brute(rows)


def test_containers_round_trip():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(1 << 16, n, replace=False)).astype(np.uint16) for n in (1, 5, 4095, 4096, 4097, 60000)]
    bounds = np.cumsum([0, *map(len, sets)])
    group, place = _decode(_encode(np.concatenate(sets), bounds))
    assert all((np.sort(place[group == i]) == s).all() for i, s in enumerate(sets))


def test_union_over_batches_and_chunks():
    rng = np.random.default_rng(1)
    want, parts = defaultdict(set), []
    for _ in range(6):
        ids = np.unique(rng.integers(0, 200_000, 30_000))
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([["a"] if i % 2 else ["a", "b"] for i in ids]), pa.array([[1] if i % 2 else [1, 2] for i in ids], pa.list_(pa.int32()))], ["no", "terms", "counts"])
        for i in ids:
            want["a"].add(i)
            if i % 2 == 0:
                want["b"].add(i)
        parts += list(_containers([batch]))
    table = pa.Table.from_batches(parts).sort_by([("term", "ascending"), ("chunk", "ascending")])
    out = pa.Table.from_batches(list(_unite(iter(table.to_batches(max_chunksize=3))))).to_pydict()
    got = Counter()
    for t, n in zip(out["term"], out["n_records"]):
        got[t] += n
    assert got == {t: len(s) for t, s in want.items()}
