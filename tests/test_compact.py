"""Consolidation of tiny files."""

import posixpath

import pytest
from pyspark.sql import functions as F

from triloom.operators.compact import compact, left_out, resolved, trimmed

SCHEMA = "file_no long, path string, func string, n_bytes long, body string"


def made(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def nos(df, c="file_no"):
    return sorted(r[c] for r in df.select(c).collect())


PATHS = ["a/b", "a//b", "./a/b", "a\\b", "a/x/../b", "/a/b", "//a/b/", "../a", "x/../../a", "/../a", ".", "", "a/..b", "a/.b/..", "a/b/./", "\\a\\b", "..\\..", "a/../..", "/"]


def test_paths_resolve_as_posix_does(spark):
    df = made(spark, [(i, p, None, None, None) for i, p in enumerate(PATHS)]).select("path", resolved(F.col("path")).alias("r"))
    for path, r in df.collect():
        want = posixpath.normpath(path.replace("\\", "/"))
        want = "/" + want.lstrip("/") if want.startswith("/") else want
        assert r == ("" if want == "." else want), path


def test_names_are_trimmed_of_any_white_space(spark):
    names = ["f", " f", "f\r\n", " f ", "\x0bf\t", "f g", "", "   "]
    got = [r[0] for r in made(spark, [(i, None, n, None, None) for i, n in enumerate(names)]).orderBy("file_no").select(trimmed(F.col("func"))).collect()]
    assert got == [n.strip() for n in names]


def test_each_record_once_with_the_smallest_number(spark):
    rows = [
        (5, "a/b", "f", 1, "x"), (2, "./a//b", "f ", 9, "x"), (7, "a\\b", "\tf", 1, "x"),
        (1, "a/b", None, 1, "x"), (3, "a/b", None, 1, "x"), (4, "a/b", "", 1, "x"), (8, "a/B", "f", 1, "x"),
        (9, None, "f", 1, "x"), (10, None, "f", None, "x"), (11, "a/b", "f", 1, None), (12, "a/b", "f", 1, None), (13, "a/b", "f", 1, ""),
    ]
    packed = compact(made(spark, rows))
    assert nos(left_out(made(spark, rows), packed)) == [3, 5, 7, 10, 12]
    assert nos(packed.read()) == [1, 2, 4, 8, 9, 11, 13]
    kept = {r.file_no: tuple(r) for r in packed.read().collect()}
    assert all(kept[r[0]] == r for r in rows if r[0] in kept)


def test_rows_without_number_and_repeated_rows(spark):
    rows = [(None, "a", "f", 1, "x"), (None, "a", "f", 2, "x"), (3, "b", "f", 1, "y"), (None, "b", "f", 1, "y"), (4, "c", "f", 1, "z"), (4, "c", "f", 1, "z")]
    packed = compact(made(spark, rows))
    got = packed.read().collect()
    assert sorted((r.path, r.file_no or 0) for r in got) == [("a", 0), ("b", 3), ("c", 4)]
    assert nos(left_out(made(spark, rows), packed)) == []


def test_empty_table(spark):
    packed = compact(made(spark, []))
    assert packed.read().count() == 0 and packed.manifest.count() == 0 and left_out(made(spark, []), packed).count() == 0


def test_clashing_columns_and_long_bodies_are_kept(spark):
    long = "äx" * 600_000
    rows = [(1, "a", "f", 1, long, 7, 8, "n"), (2, "a", "f", 1, long, 9, 8, "m"), (3, "a", "f", 1, long + "!", 9, None, None)]
    df = made(spark, rows, SCHEMA + ", _key int, _no int, `_si.ze` string")
    packed = compact(df)
    assert sorted(tuple(r) for r in packed.read().collect()) == [rows[0], rows[2]]


def test_groups_are_balanced_longest_first(spark):
    rows = [(i, f"p{i}", "f", None, "x" * (1000 if i % 50 == 0 else i % 97)) for i in range(2000)]
    packed = compact(made(spark, rows), groups=3)
    m = packed.manifest.collect()
    assert sum(r.n_rows for r in m) == 2000
    loads = [r.n_bytes + r.n_rows for r in m if r.shard == 0]
    assert len(loads) == 3 and max(loads) - min(loads) <= 1001


def test_several_shards_and_a_hot_record(spark):
    df = spark.range(3000).select(F.col("id").alias("file_no"), F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("path"), F.lit("f").alias("func"), F.lit(1).cast("long").alias("n_bytes"), F.lit("x" * 100).alias("body"))
    packed = compact(df, target_bytes=10_000)
    assert packed.manifest.select("shard").distinct().count() > 1
    assert packed.read().count() == 2001 and left_out(df, packed).count() == 999


def test_files_outside_the_manifest_are_no_part_of_it(spark):
    df = made(spark, [(1, "a", "f", 1, "x")])
    packed = compact(df)
    df.write.mode("append").parquet(packed.path + "/data")  # as an attempt that failed would leave
    assert packed.read().count() == 1


def test_nothing_is_published_if_rows_are_missing(spark, monkeypatch):
    from triloom.operators import compact as module

    real = module._packer

    def lossy(*args):
        run = real(*args)
        return lambda batches: run(b.slice(1) for b in batches)

    monkeypatch.setattr(module, "_packer", lossy)
    with pytest.raises(RuntimeError, match="nothing was published"):
        compact(made(spark, [(1, "a", "f", 1, "x"), (2, "b", "f", 1, "x")]))


def test_nothing_is_published_if_files_are_not_what_was_written(spark, monkeypatch):
    from triloom.operators import compact as module

    real = module._files
    monkeypatch.setattr(module, "_files", lambda *args: real(*args).withColumn("body", F.regexp_replace("body", "q", "r")))
    with pytest.raises(RuntimeError, match="files differ"):
        compact(made(spark, [(1, "a", "f", 1, "x"), (2, "b", "f", 1, "q")]))


def test_many_repeated_records_take_the_other_way(spark, monkeypatch):
    from triloom.operators import compact as module

    df = spark.range(400).select(F.col("id").alias("file_no"), F.concat(F.lit("p"), F.col("id") % 150).alias("path"), F.lit("f").alias("func"), F.lit(1).cast("long").alias("n_bytes"), F.lit("x").alias("body"))
    assert nos(left_out(df, compact(df))) == list(range(150, 400))
    monkeypatch.setattr(module, "MOST_REPEATED", 3)
    assert nos(left_out(df, compact(df))) == list(range(150, 400))


def test_real_files_and_a_published_folder(spark, tmp_path):
    from triloom.sources.readers import tiny_files

    (tmp_path / "in" / "x" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "in" / "empty").mkdir()
    (tmp_path / "in" / "x" / "none.vec").write_text("")
    (tmp_path / "in" / "x" / "deep" / "er" / "b.txt").write_bytes(b"\xff\xfe\x00z")
    assert [(r.path.rsplit("/", 1)[1], r.func, r.n_bytes) for r in tiny_files(spark, f"file://{tmp_path}/in", "*.t?t").collect()] == [("b.txt", "b", 4)]
    kept = compact(tiny_files(spark, f"file:{tmp_path}/in"), out=f"file:{tmp_path}/small").read()
    assert kept.select(F.hex(F.col("body").cast("binary"))).first()[0] == "FFFE007A"
    (tmp_path / "in" / "x" / "deep" / "er" / "b.txt").unlink()
    for i in range(1, 41):
        (tmp_path / "in" / "x" / f"f{i}.vec").write_text("1," * i)
    out = f"file://{tmp_path}/out"
    packed = compact(tiny_files(spark, str(tmp_path / "in")), out=out)
    assert packed.read().count() == 40 and packed.read().agg(F.sum("n_bytes")).first()[0] == sum(2 * i for i in range(1, 41))
    assert {r.func for r in packed.read().collect()} == {f"f{i}" for i in range(1, 41)}
    with pytest.raises(FileExistsError):
        compact(tiny_files(spark, str(tmp_path / "in")), out=out)
