"""Equal or nearly equal records across splits, by content-defined chunks.

A record is normalised to the sorted hashes of its distinct tokens and cut where a hash over the last token meets a mask,
so a cut depends on nothing but the content at hand, and a change disturbs only the chunks next to it. Chunk digests are
joined across the splits; the shared chunks' lengths give each record's overlap. A token that only one record has breaks
at most two chunks, so a record with more than 2d chunks, d being the largest symmetric difference that the similarity
allows, shares a chunk with each partner. Records that are cut into fewer chunks meet each other at the second level, at
which every token is a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.llm import sets as S
from triloom.session import arrow, col, cut

#: One token in so many ends a chunk.
SPACING = 3
#: The roles of the training split and of the evaluation split.
TRAINING, EVALUATION = ["vuln", "patch"], ["before", "after"]


def role_of(path: Column) -> Column:
    """The directory right above ``<hash>_<epoch>`` in a path, where ``/`` and ``\\`` both separate; null if there is none."""
    role = F.regexp_extract(path, r"^(?:.*[/\\])?([^/\\]+)[/\\]+[0-9a-fA-F]+_[0-9]+[/\\]+[^/\\]+[/\\]+graph[/\\]", 1)
    other = F.regexp_extract(path, r"^(?:.*[/\\])?([^/\\]+)[/\\]+[0-9a-fA-F]{7,}_[0-9]+(?:[/\\]|$)", 1)
    return F.coalesce(F.nullif(role, F.lit("")), F.nullif(other, F.lit("")))


def _chunks(t: float, level: int):
    """(id, key, size, position ..) of every chunk of a record; level 1 is for records that have too few at level 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                get = lambda c: batch.column(batch.schema.get_field_index(c))
                ident, bits, blk, n = (get(c).to_numpy() for c in ("id", "bits", "blk", "n"))
                sides = [get(c).to_numpy(zero_copy_only=False) for c in ("left", "right")]
                row, h = S.flat(batch, "tokens")
                if not len(h):
                    continue
                ends = S.mixed(h, 4) % np.uint64(SPACING) == 0 if level == 0 else np.ones(len(h), bool)
                last = np.r_[row[1:] != row[:-1], True]
                stop = np.flatnonzero(ends | last)
                start = np.r_[0, stop[:-1] + 1]
                digest = S.mixed(np.bitwise_xor.reduceat(S.mixed(h, 5), start) + np.add.reduceat(S.mixed(h, 6), start), 7)
                r = row[start]
                count = np.bincount(r, minlength=batch.num_rows)
                need = 2 * np.floor(n * (1 - t) / t + 1e-9).astype(np.int64) + 1
                need = need if level == 0 else (need + 1) // 2
                keep = np.ones(len(r), bool)
                if level:
                    first = np.bincount(row[(S.mixed(h, 4) % np.uint64(SPACING) == 0) | last], minlength=batch.num_rows)
                    keep = ((first < 2 * need - 1) | (bits > 0))[r]
                r, k = r[keep], digest[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), level, np.int32)), pa.array(k.view(np.int64)), pa.array(ident[r]), pa.array(bits[r]), pa.array(n[r]), *[pa.array(s[r]) for s in sides], pa.array(count[r]), pa.array(need[r]), pa.array((stop - start + 1)[keep].astype(np.int32))],
                    ["grp", "key", "id", "bits", "n", "left", "right", "total", "need", "size"],
                )

    return run


_SCHEMA = "grp int, key long, id long, bits int, n long, left boolean, right boolean, total long, need long, size int"


def _sided(df: DataFrame, splits: DataFrame, record: str, parts: tuple[str, ...], names: DataFrame):
    found = S.token_sets(df, record, parts)
    members, reps = S.classes(found)
    # a record may stand in both splits, if its versions do
    members = cut(members.join(names, "rec"), "members")
    sides = members.groupBy("rep").agg(F.max(F.col("split") == "train").alias("left"), F.max(F.col("split") == "eval").alias("right"))
    return found, members, reps.join(sides.withColumnRenamed("rep", "id"), "id")


@dataclass
class Alike:
    """``members``: rec, rep, split, .. of every record of a split. ``exact``: paired representatives (id_a, id_b, n_a, n_b, both). ``reps``: their sets."""

    members: DataFrame
    exact: DataFrame
    reps: DataFrame
    t: float


def alike(df: DataFrame, funcs: DataFrame, record: str = "fn_id", parts: tuple[str, ...] = ("a", "rel", "b"), path: str = "path", t: float = 0.9) -> Alike:
    """Representatives of equal sets, one with a training and the other with an evaluation record, of a Jaccard similarity of at least ``t``.

    The split follows from the role in ``funcs.path``: vuln and patch train, before and after evaluate; records of other
    or no role are left out. Rows with a null part or record are left out, repeated rows count once; empty tables give no rows.
    """
    role = role_of(col(funcs, path))
    split = F.when(role.isin(TRAINING), "train").when(role.isin(EVALUATION), "eval")
    names = funcs.select(col(funcs, record).cast("string").alias("rec"), split.alias("split")).dropna().distinct()
    found, members, reps = _sided(df, funcs, record, parts, names)
    reps = cut(reps, "reps")
    blocks = reps.where("bits > 0").limit(1).count() > 0
    keys = reps.transform(arrow, _chunks(t, 0), _SCHEMA).unionByName(reps.transform(arrow, _chunks(t, 1), _SCHEMA))
    if blocks:  # chunks end at a block's end too: each of the 2^bits ends may break one more
        totals = keys.groupBy("grp", "id").agg(F.count("*").alias("total"))
        keys = keys.drop("total").join(totals, ["grp", "id"]).withColumn("need", F.when(F.col("grp") == 0, F.col("need") + F.expr("shiftleft(1L, bits)")).otherwise(F.col("need")))
    post = S.posted(keys.drop("size"), sided=True)
    post = cut(post, "chunks")
    a = post.where("left").select("grp", "key", F.col("id").alias("id_a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    b = post.where("right").select("grp", "key", F.col("id").alias("id_b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(t) - 1e-6
    met = a.join(b, ["grp", "key"]).where("id_a <> id_b").where(near).select("id_a", "id_b", "bits_a", "bits_b", "n_a", "n_b").distinct()
    exact = S.shared(found, met).where(F.col("both") >= F.lit(t) * (F.col("n_a") + F.col("n_b") - F.col("both")) - 1e-9)
    exact = cut(exact, "alike")
    return Alike(members, exact, reps, t)


def pairs(found: Alike) -> DataFrame:
    """(fn_a, fn_b, split_a, split_b), fn_a < fn_b: all pairs of a training and an evaluation record that are alike, each once."""
    ends = found.exact.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    return S.expanded(ends, found.members).where("split_a <> split_b").distinct()


def overlaps(found: Alike) -> DataFrame:
    """The paired representatives (fn_a, fn_b: the smallest names of records with equal sets) with n_a, n_b, both (tokens shared) and, from the lengths of the chunks shared, overlap_a and overlap_b."""
    exact, members = found.exact, found.members
    wanted = exact.select(F.col("id_a").alias("id")).unionAll(exact.select(F.col("id_b").alias("id"))).distinct()
    cuts = found.reps.join(wanted, "id", "left_semi").transform(arrow, _chunks(found.t, 0), _SCHEMA).select("id", "key", "size")
    ca = cuts.select(F.col("id").alias("id_a"), "key", "size")
    cb = cuts.select(F.col("id").alias("id_b"), "key")
    length = exact.select("id_a", "id_b").join(ca, "id_a").join(cb, ["id_b", "key"]).groupBy("id_a", "id_b").agg(F.sum("size").alias("chunked"))
    name = lambda x: members.groupBy("rep").agg(F.min("rec").alias(f"fn_{x}")).withColumnRenamed("rep", f"id_{x}")
    named = exact.join(length, ["id_a", "id_b"], "left").join(name("a"), "id_a").join(name("b"), "id_b")
    return named.select("fn_a", "fn_b", "n_a", "n_b", "both", (F.coalesce("chunked", F.lit(0)) / F.col("n_a")).alias("overlap_a"), (F.coalesce("chunked", F.lit(0)) / F.col("n_b")).alias("overlap_b"))


def overlap_report(found: Alike, funcs: DataFrame, record: str = "fn_id", repo: str = "repo") -> DataFrame:
    """For each split and repo: records that have a partner in the other split, and pairs they are in.

    Counted from classes: a record's partners are the other split's members of its own class and of those it is paired
    with, so no pair of records is ever listed.
    """
    sizes = found.members.groupBy("rep", "split").agg(F.count_distinct("rec").alias("k"))
    links = found.exact.select("id_a", "id_b").unionAll(found.exact.select("id_b", "id_a")).unionAll(found.members.select("rep", "rep")).toDF("rep", "other").distinct()
    facing = links.join(sizes.select(F.col("rep").alias("other"), F.when(F.col("split") == "train", "eval").otherwise("train").alias("split"), "k"), "other").groupBy("rep", "split").agg(F.sum("k").alias("n"))
    both = found.members.groupBy("rec").agg((F.count_distinct("split") - 1).alias("own"))  # a record of both splits is no partner of itself
    per = found.members.select("rec", "rep", "split").distinct().join(facing, ["rep", "split"]).join(both, "rec").select("rec", "split", (F.col("n") - F.col("own")).alias("n")).where("n > 0")
    named = funcs.select(col(funcs, record).cast("string").alias("rec"), col(funcs, repo).alias("repo")).distinct()
    return per.join(named, "rec").groupBy("split", "repo").agg(F.countDistinct("rec").alias("n_records"), F.sum("n").alias("n_pairs"))


def cross_split(df: DataFrame, funcs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """What :func:`pairs` and :func:`overlaps` give for :func:`alike`."""
    found = alike(df, funcs, **how)
    return pairs(found), overlaps(found)
