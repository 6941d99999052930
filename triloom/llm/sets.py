"""Similarity joins over sets of tokens: the parts that the operators on triple sets share.

A record's set is kept as a sorted array of 64-bit token hashes (two different tokens of a pair of sets of a few hundred
meet with a chance below 1e-14). A set of more than BIG rows is kept in blocks by the leading bits of its hashes, so no
array grows with the largest record. Records with equal sets form a class; only one record of each class is joined, and
pairs are expanded to the members at the end.

Candidates come from keys (part fingerprints, chunk digests) of which two similar sets must share some. Which of them
a record posts follows one order over all keys, rarest first by an exact count: if two records share s keys or more and
each leaves out at most s - 1 of its most frequent ones, the rarest shared key is posted by both. Frequent keys thus drop
out without losing a pair, and keys that can't meet another record never reach the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.session import arrow, col, cut

#: Rows of one record up to which its set is one array.
BIG = 1_000_000


def token_sets(df: DataFrame, record: str, parts: Sequence[str]) -> DataFrame:
    """The set of distinct tokens (tuples of ``parts``) of every record, written to the shared folder.

    Columns: id, rec, bits and blk (this row holds the tokens whose leading ``bits`` bits are ``blk``), n (size of the
    whole set), d1 and d2 (a fingerprint of the whole set), tokens. Rows with a null part or record are left out.
    """
    rows = df.dropna(subset=[record, *parts]).select(col(df, record).cast("string").alias("rec"), F.xxhash64(*[col(df, c) for c in parts]).alias("h"))
    big = cut(df.select(col(df, record).cast("string").alias("rec")).groupBy("rec").count().where(F.col("count") > BIG), "big")
    split = not big.isEmpty()
    if split:  # at most one for each BIG rows
        bits = big.select("rec", F.ceil(F.log2(F.col("count") / BIG)).cast("int").alias("bits"))
        rows = rows.join(F.broadcast(bits), "rec", "left").withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("blk", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0).cast("long")))
    else:
        rows = rows.withColumns({"bits": F.lit(0), "blk": F.lit(0).cast("long")})
    bags = rows.select("rec", "bits", "blk", "h").transform(arrow, _bags, "rec string, bits int, blk long, tokens array<long>")
    sets = bags.groupBy("rec", "bits", "blk").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"))
    sets = sets.withColumns({"n": F.size("tokens").cast("long"), "d1": F.xxhash64("blk", "tokens"), "d2": F.xxhash64(F.lit(1), "tokens", "blk")})
    if not split:
        return cut(sets.select(F.monotonically_increasing_id().alias("id"), "rec", "bits", "blk", "n", "d1", "d2", "tokens"), "sets")
    sets = cut(sets, "blocks")
    whole = cut(sets.groupBy("rec").agg(F.sum("n").alias("n"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2")).withColumn("id", F.monotonically_increasing_id()), "wholes")
    return cut(sets.drop("n", "d1", "d2").join(whole, "rec").select("id", "rec", "bits", "blk", "n", "d1", "d2", "tokens"), "sets")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one record and block in a row or nearby become one row with their tokens."""
    held: list[pa.RecordBatch] = []
    n = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rec = t.column(0).combine_chunks().dictionary_encode()
        rec = rec.combine_chunks() if isinstance(rec, pa.ChunkedArray) else rec
        code, bits, blk, h = rec.indices.to_numpy(), *(t.column(i).to_numpy() for i in (1, 2, 3))
        order = np.lexsort((h, blk, code))
        code, bits, blk, h = code[order], bits[order], blk[order], h[order]
        same = (code[1:] == code[:-1]) & (blk[1:] == blk[:-1])
        new = np.r_[True, ~(same & (h[1:] == h[:-1]))]
        start = np.r_[True, ~same][new]
        code, bits, blk, h = code[new], bits[new], blk[new], h[new]
        first = np.flatnonzero(start)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(h))
        return pa.RecordBatch.from_arrays([rec.dictionary.take(pa.array(code[first])), pa.array(bits[first]), pa.array(blk[first]), lists], ["rec", "bits", "blk", "tokens"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 200_000:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): rec with the id of its class, and the set rows of one record of each class, the one with the smallest name."""
    one = sets.select("id", "rec", "n", "d1", "d2").distinct() if sets.where("bits > 0").limit(1).count() else sets.select("id", "rec", "n", "d1", "d2")
    rep = one.groupBy("n", "d1", "d2").agg(F.min(F.struct("rec", "id")).alias("least"), F.count("*").alias("copies"))
    rep = cut(rep.select("n", "d1", "d2", F.col("least.id").alias("rep"), "copies"), "classes")
    members = one.join(rep, ["n", "d1", "d2"]).select("rec", "rep", "n", "copies")
    reps = sets.join(rep.select(F.col("rep").alias("id"), "copies"), "id").drop("rec", "d1", "d2")
    return members, reps


def posted(keys: DataFrame, sided: bool = False) -> DataFrame:
    """The keys that records post: of the ``total`` keys of (grp, id) the ``need`` rarest, of those that can meet.

    ``keys`` has grp, id, key, total, need and what else to carry along; with ``sided`` also left and right, and a key
    can meet only if some record has it on the left and another on the right. Counts are exact and combined before the
    shuffle; the joins that follow are split by adaptive execution where a key is hot.
    """
    counts = keys.groupBy("grp", "key").agg(F.count("*").alias("c"), *([F.max("left").alias("l"), F.max("right").alias("r")] if sided else []))
    counts = counts.where("c > 1" + " and l and r" * sided).select("grp", "key", "c")
    live = keys.join(counts, ["grp", "key"])
    each = Window.partitionBy("grp", "id")
    live = live.withColumns({"rank": F.row_number().over(each.orderBy("c", "key")), "alive": F.count("*").over(each)})
    # the total - alive keys that meet nobody come first in the order
    return live.where("rank <= need - (total - alive)").drop("rank", "alive", "c", "total", "need")


def shared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (id_a, id_b, bits_a, bits_b and others) with ``both``, the exact size of the sets' intersection.

    Sets in blocks are intersected block by block.
    """
    cells = pairs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, greatest(bits_a, bits_b))") - 1)))
    cells = cells.withColumns({"blk_a": F.expr("shiftright(k, greatest(bits_a, bits_b) - bits_a)"), "blk_b": F.expr("shiftright(k, greatest(bits_a, bits_b) - bits_b)")})
    a = sets.select(F.col("id").alias("id_a"), F.col("blk").alias("blk_a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("blk").alias("blk_b"), F.col("tokens").alias("tokens_b"))
    met = cells.join(a, ["id_a", "blk_a"]).join(b, ["id_b", "blk_b"])
    names = pairs.columns
    return met.select(*names, F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("both")).groupBy(*names).agg(F.sum("both").alias("both"))


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(fn_a, fn_b), fn_a < fn_b, of all members of paired classes (id_a, id_b), and of each class among themselves.

    ``members``: rec, rep, copies and what else to carry along as *_a and *_b.
    """
    more = [c for c in members.columns if c not in ("rec", "rep", "n", "copies")]
    side = lambda x: members.select(F.col("rep").alias(f"id_{x}"), F.col("rec").alias(f"fn_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more])
    own = members.where("copies > 1").select(F.col("rep").alias("id_a"), F.col("rep").alias("id_b")).distinct()
    met = pairs.select("id_a", "id_b").unionByName(own).join(side("a"), "id_a").join(side("b"), "id_b").where("id_a <> id_b or fn_a < fn_b")
    swap = F.col("fn_a") > F.col("fn_b")
    return met.select(*[F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("fn", *more) for x, y in (("a", "b"), ("b", "a"))])


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the list column ``name``."""
    lists = batch.column(batch.schema.get_field_index(name))
    return np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists))), lists.flatten().to_numpy()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes (the finaliser of splitmix64)."""
    z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
