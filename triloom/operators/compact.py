"""Consolidation of tiny files: every distinct record once, in a few balanced large files.

Shape of the job: the identity of each record is reduced to a digest, the lowest number of each digest is found with
a map-side combine (so a record that makes up a third of all rows costs one partial row per task), rows that lose to a
smaller number are dropped where they are read, and the others are shuffled in full, once, into shards. A shard's task
reads its rows longest first and gives each to the least loaded of its output groups with a heap; every group is one open
pyarrow writer, so memory is bounded by the writers' row groups, whatever the shard holds. Attempts write files of their
own; only the files in the manifest are part of the result. The manifest is published after the written files were read
again and their rows, bytes and record digests found to be those of the input.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.session import address, arrow, col, cut, fresh, scratch

#: The characters that Unicode counts as white space, and the four separators U+001C to U+001F.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

LAST = (1 << 63) - 1
#: Records stored more than once (40 bytes each) up to which they are broadcast, so that their copies are dropped without a shuffle.
MOST_REPEATED = 500_000


def trimmed(c: Column) -> Column:
    """``c`` without white space at its ends; linear also for very long runs of it."""
    return F.trim(c, F.lit(WHITE))


def resolved(path: Column) -> Column:
    """The location a path leads to, without links: ``/`` and ``\\`` both separate, ``.`` and ``..`` are worked off."""
    absolute = path.rlike(r"^[/\\]")
    parts = F.filter(F.split(path, r"[/\\]+"), lambda x: (x != "") & (x != "."))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x)))
        .when((F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(absolute, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    kept = F.when(path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), folded).otherwise(parts)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def identity(path: Column, func: Column, body: Column) -> Column:
    """SHA-256 over the lengths and values of the resolved path, the trimmed name and the body; null equals only null."""
    parts = [resolved(path), trimmed(func), body]
    text = F.concat(*[x for p in parts for x in (F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit("")))])
    return F.unhex(F.sha2(text, 256))


@dataclass
class Packed:
    """A published consolidation. ``manifest``: one row for each file; ``read()``: the records."""

    spark: SparkSession
    path: str
    columns: list[str]

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{published(self.spark, self.path)}")

    def read(self) -> DataFrame:
        return _files(self.spark, self.path, self.manifest).drop("_in")


def _files(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """The rows of the files that a manifest lists, and the file's name as ``_in``."""
    listed = manifest.select(F.col("file").alias("_of"))
    return spark.read.parquet(f"{out}/data").select("*", F.col("_metadata.file_name").alias("_in")).join(listed, F.col("_in") == F.col("_of"), "left_semi")


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, out: str, name: str) -> None:
    """One small file that names the manifest, created only if there is none. It counts only when its last byte, the line's
    end, is there, and object stores show a file only when it is whole, so no rename is needed."""
    at, system = _system(spark, f"{out}/PUBLISHED")
    stream = system.create(at, False)
    stream.write(bytearray(f"{name}\n".encode()))
    stream.close()


def published(spark: SparkSession, out: str) -> str | None:
    """The name of the manifest in ``out``, or None if nothing is published."""
    at, system = _system(spark, f"{out}/PUBLISHED")
    if not system.exists(at):
        return None
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream := system.open(at), "UTF-8")
    stream.close()
    return text[:-1] if text.endswith("\n") else None


def compact(df: DataFrame, number: str = "file_no", path: str = "path", func: str = "func", body: str = "body", out: str | None = None, target_bytes: int = 256 << 20, groups: int = 4) -> Packed:
    """Put every distinct record of ``df`` into a few large Parquet files.

    Two rows are the same record if their paths resolve to the same location, their names are equal but for white space
    at the ends, and their bodies are equal; null equals only null. Of equal rows the one with the smallest number stays
    (one without a number only where none has one). All columns of ``df`` are kept. An empty table gives an empty
    manifest. ``out`` may hold what a failed run left, but no published manifest. ``target_bytes`` is the wanted size of a
    group before compression, ``groups`` the fixed number of output groups of each shard; the number of shards follows
    from the total size.
    """
    spark = df.sparkSession
    out = out or scratch(spark, "packed")
    if published(spark, out):
        raise FileExistsError(f"{out} holds a published consolidation")
    key, no, size, least = fresh(df, "key", "no", "size", "least")
    keys = lambda x: identity(col(x, path), col(x, func), col(x, body))
    length = lambda x: F.coalesce(F.octet_length(col(x, body)), F.lit(0)).cast("long")
    keyed = df.withColumns({key: keys(df), no: F.coalesce(col(df, number).cast("long"), F.lit(LAST)), size: length(df)})
    winners = cut(keyed.groupBy(key).agg(F.min(no).alias(no), F.max(size).alias(size), F.count("*").alias("_n")), "winners")
    rows, total, marks, repeated = winners.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(key)), F.lit(0)), F.count_if(F.col("_n") > 1)).first()
    shards = max(1, -(-total // (target_bytes * groups)), -(-rows // 5_000_000))
    if repeated <= MOST_REPEATED:
        # only rows of repeated records can lose, and what those lose to fits in every task
        first = winners.where("_n > 1").select(key, F.col(no).alias(least))
        keyed = keyed.join(F.broadcast(first), key, "left").where(F.col(least).isNull() | (F.col(no) == F.col(least))).drop(least)
        kept = keyed.repartition(shards, key, no)
    else:
        # both sides are laid out alike, so the join needs no further exchange, and its output is already sharded
        kept = keyed.repartition(shards, key, no).join(winners.select(key, no).repartition(shards, key, no), [key, no], "left_semi")
    names = df.columns
    kept = kept.sortWithinPartitions(F.desc(size), key, no).select(*[col(df, c) for c in names], key, size, no)
    plain = [f"c{i}" for i in range(len(names))]  # mapInArrow can't take names with dots
    written = kept.toDF(*plain, key, size, no).transform(arrow, _packer(f"{out}/data", groups, names, key, size, no), "file string, shard long, grp int, n_rows long, n_bytes long, longest long, marks long")
    manifest = f"_manifest-{uuid.uuid4().hex}"
    written.write.parquet(f"{out}/{manifest}")
    staged = spark.read.parquet(f"{out}/{manifest}")
    if not rows:
        df.limit(0).write.mode("append").parquet(f"{out}/data")
    # what was written is read again, file by file
    back = _files(spark, out, staged)
    each = back.groupBy("_in").agg(F.count("*").alias("rows"), F.sum(length(back)).alias("bytes"), F.bit_xor(F.xxhash64(keys(back))).alias("seen"))
    both = staged.join(each, F.col("file") == F.col("_in"), "left").select("*", (F.col("n_rows").eqNullSafe(F.col("rows")) & F.col("n_bytes").eqNullSafe(F.col("bytes")) & F.col("marks").eqNullSafe(F.col("seen"))).alias("same"))
    *got, good = both.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.bit_xor("marks"), F.lit(0)), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.bool_and("same"), F.lit(True))).first()
    if tuple(got) != (rows, marks, total) or not good:
        raise RuntimeError(f"packed {tuple(got)} rows, marks and bytes instead of {(rows, marks, total)}{'' if good else ', and files differ from what was written'}; nothing was published")
    _publish(spark, out, manifest)
    return Packed(spark, out, names)


def _packer(folder: str, groups: int, names: list[str], key: str, size: str, no: str):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        import xxhash
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        system, base = fs.FileSystem.from_uri(address(folder)) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        heap = [(0, g) for g in range(groups)]
        writers: dict[int, pq.ParquetWriter] = {}
        held: dict[int, list] = {g: [] for g in range(groups)}
        stats = {g: [0, 0, 0, 0] for g in range(groups)}
        waiting = [0] * groups
        last = None

        def flush(g: int) -> None:
            if held[g]:
                t = pa.Table.from_batches(held[g]).combine_chunks()
                if g not in writers:
                    writers[g] = pq.ParquetWriter(f"{base}/part-{shard:05d}-{g}-{attempt}.parquet", t.schema, filesystem=system, compression="zstd")
                writers[g].write_table(t)
                held[g], waiting[g] = [], 0

        for batch in batches:
            keys, sizes, nos = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, size, no))
            rows = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)
            picks: dict[int, list[int]] = {}
            for i, (k, n, m) in enumerate(zip(keys, sizes, nos)):
                if (k, m) == last:  # rows repeated with their number
                    continue
                last = (k, m)
                load, g = heapq.heappop(heap)
                heapq.heappush(heap, (load + n + 1, g))  # 1: empty bodies are spread, too
                picks.setdefault(g, []).append(i)
                s = stats[g]
                s[0] += 1
                s[1] += n
                s[2] = max(s[2], n)
                s[3] ^= _spark_xxhash(xxhash, k)
            for g, at in picks.items():
                part = rows.take(pa.array(at, pa.int64()))
                held[g].append(part)
                waiting[g] += part.nbytes
                if waiting[g] > 8 << 20:
                    flush(g)
        for g in range(groups):
            flush(g)
        for w in writers.values():
            w.close()
        out = [(f"part-{shard:05d}-{g}-{attempt}.parquet", shard, g, *stats[g]) for g in sorted(writers)]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*out)) or [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["file", "shard", "grp", "n_rows", "n_bytes", "longest", "marks"])

    return run


def _spark_xxhash(xxhash, data: bytes) -> int:
    """What Spark's ``xxhash64`` gives for a binary value (seed 42), as a signed number."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def left_out(df: DataFrame, packed: Packed, number: str = "file_no") -> DataFrame:
    """Numbers of the rows whose record is in the packed files under a smaller number."""
    mine = df.select(col(df, number).cast("long").alias("file_no")).where("file_no is not null")
    return mine.join(packed.read().select(col(df, number).cast("long").alias("file_no")), "file_no", "left_anti")
