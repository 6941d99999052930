"""Groups of records whose sets are alike: a parity-sketch join.

Each token falls into one of m parts, and a part's word is the XOR of its tokens' hashes. A token that only one of two
sets has changes one word, so the number of words that differ is a lower bound of the symmetric difference, and two sets
of similarity t and sizes a and b differ in at most d = (1 - t) / (1 + t) · (a + b) words: m - d words are equal. Sets are
joined on equal words in bands of sizes, in which m and d fit; a record is in the band of its size and, if it
can have partners there, in the one below.
Candidates whose bit sketches (one bit flipped for each token) are further apart than d in Hamming distance are dropped,
the others verified on the sets.

Pairs with a set of at most SMALL tokens have a band for each pair of sizes and a word for the whole set: the XOR of all
its tokens, with as many XORed out as such a pair may differ in. Two sets meet if what is left is the same, so if they are
alike, and no word is shared by sets that are not. The method is meant for t of 0.6 or more: below, d exceeds the words of small sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm import sets as S
from triloom.session import arrow, cut

#: Words of 64 bits in a record's bit sketch.
SKETCH = 8
#: Parts of a set, at least: with more parts than tokens, hardly any set has fewer full parts than it must post (one in a million of 10 tokens).
PARTS = 64
#: Words that a small set may post for partners of one size.
MOST_WORDS = 512


def _wide(t: float) -> float:
    """The ratio of a band's ends. A set has partners at most one band below its own, and the wider the bands, the fewer sets have any there."""
    return max(2.0, 1 / t)


def _band(n: np.ndarray, t: float) -> np.ndarray:
    return np.floor(np.log(n) / np.log(_wide(t)) + 1e-9).astype(np.int64)


def _most(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The largest symmetric difference of sets of sizes a and b with similarity t."""
    return np.floor((1 - t) / (1 + t) * (a + b) + 1e-9).astype(np.int64)


def _keys(t: float):
    """For each set row: its part words in its own band and the one below, and its bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ident, bits, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "bits", "n"))
                row, h = S.flat(batch, "tokens")
                label, place = S.mixed(h, 1), S.mixed(h, 2)
                own = _band(n, t)
                for home in (True, False):
                    band = own if home else own - 1
                    high = np.power(_wide(t), band + 1)  # sizes below are at home here
                    d_band = _most(high, high / t, t)
                    m = np.maximum(2 * (d_band + 1), PARTS)
                    # partners: at home, or guests up to the size t allows; for a guest only those at home
                    need = _most(n, np.minimum(n / t, high / t) if home else np.minimum(n, high), t) + 1
                    use = np.flatnonzero((band >= 0) & (home | (n * t < high + 1)))
                    ok = np.isin(row, use)
                    r, part = row[ok], (place[ok] % m[row[ok]].astype(np.uint64)).astype(np.int64)
                    order = np.argsort(r * (1 << 32) + part, kind="stable")
                    r, part, x = r[order], part[order], label[ok][order]
                    if not len(r):
                        continue
                    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (part[1:] != part[:-1])])
                    full = np.bincount(r[first], minlength=batch.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (band[r[first]].astype(np.int32), part[first].astype(np.int32), ident[r[first]], bits[r[first]], n[r[first]], np.full(len(first), home), np.bitwise_xor.reduceat(x, first).view(np.int64), m[r[first]].astype(np.int32), need[r[first]].astype(np.int32), full[r[first]])],
                        ["grp", "part", "id", "bits", "n", "home", "word", "m", "need", "total"],
                    )

    return run


def _least(a: int, b: int, t: float) -> int:
    """The tokens that sets of sizes a and b with similarity t share, at least."""
    return int(np.ceil(t / (1 + t) * (a + b) - 1e-9))


@functools.cache
def _small(t: float) -> int:
    """The size up to which sets are small: 9 for t = 0.7."""
    n = 0
    while n < 16 and all(comb(b, _least(n + 1, b, t)) <= MOST_WORDS for b in range(n + 1, int((n + 1) / t + 1e-9) + 1)):
        n += 1
    return n


def _small_keys(t: float):
    """For each set of at most small / t tokens its words for partners of each size, where one of the two is small."""
    most = _small(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ident, bits, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("id", "bits", "n"))
                row, h = S.flat(batch, "tokens")
                label, first = S.mixed(h, 1), np.r_[0, np.cumsum(n)]
                for a in np.unique(n):
                    who = np.flatnonzero(n == a)
                    sets = label[first[who][:, None] + np.arange(a)]
                    for b in range(max(1, int(np.ceil(a * t - 1e-9))), int(a / t + 1e-9) + 1):
                        keep = _least(a, b, t)
                        if min(a, b) > most or keep > min(a, b):
                            continue
                        pick = np.array(list(combinations(range(a), keep)), np.int64)
                        words = np.bitwise_xor.reduce(sets[:, pick], axis=2).ravel().view(np.int64)
                        r = np.repeat(who, len(pick))
                        low, high = min(a, b), max(a, b)
                        grp = np.full(len(r), -1 - (low << 10) - high, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (grp, words, ident[r], bits[r], n[r], np.full(len(r), a == low), np.full(len(r), a == high))], ["grp", "key", "id", "bits", "n", "home", "guest"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, h = S.flat(batch, "tokens")
        bit = (S.mixed(h, 3) % np.uint64(64 * SKETCH)).astype(np.int64)
        odd = (np.bincount(row * 64 * SKETCH + bit, minlength=batch.num_rows * 64 * SKETCH) & 1).astype(np.uint8)
        words = np.packbits(odd.reshape(batch.num_rows, SKETCH, 64), axis=2).view(">i8").astype(np.int64).reshape(batch.num_rows, SKETCH)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH)]], ["id", *[f"w{i}" for i in range(SKETCH)]])


def similar_pairs(sets: DataFrame, reps: DataFrame, t: float) -> DataFrame:
    """(id_a, id_b, n_a, n_b, both) of all pairs of representatives with |A ∩ B| / |A ∪ B| of at least ``t``."""
    schema = "grp int, part int, id long, bits int, n long, home boolean, word long, m int, need int, total long"
    small = _small(t)
    words = reps.where(F.col("n") > small).select("id", "bits", "n", "tokens").transform(arrow, _keys(t), schema)
    blocks = reps.where("bits > 0").limit(1).count() > 0
    if blocks:  # a part's word is the XOR over the blocks
        words = words.groupBy("grp", "part", "id", "bits", "n", "home", "m", "need").agg(F.bit_xor("word").alias("word"))
        words = words.join(words.groupBy("grp", "id").agg(F.count("*").alias("total")), ["grp", "id"])
    # Empty parts are words too, the most frequent of all, so they are left out first. Hardly any record has so few full
    # parts that some of its empty ones are needed: it posts all full parts, and of the empty ones the first in order.
    keys = words.select("grp", F.xxhash64("part", "word").alias("key"), "id", "bits", "n", "home", "total", F.least("need", "total").alias("need"))
    short = words.where("total < need").select("grp", "id", "bits", "n", "home", "m", (F.col("need") - F.col("total")).alias("more"), "part")
    short = short.groupBy("grp", "id", "bits", "n", "home", "m", "more").agg(F.collect_list("part").alias("held"))  # fewer than need
    empty = short.select("*", F.posexplode(F.array_except(F.sequence(F.lit(0), F.col("m") - 1), "held")).alias("at", "part")).where("at < more")
    empty = empty.select("grp", F.xxhash64("part", F.lit(0).cast("long")).alias("key"), "id", "bits", "n", "home")
    post = cut(S.posted(keys).unionByName(empty), "words")
    a = post.where("home").select("grp", "key", F.col("id").alias("id_a"), F.col("bits").alias("bits_a"), F.col("n").alias("n_a"))
    b = post.select("grp", "key", F.col("id").alias("id_b"), F.col("bits").alias("bits_b"), F.col("n").alias("n_b"), F.col("home").alias("home_b"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(t) - 1e-6
    met = a.join(b, ["grp", "key"]).where("id_a <> id_b and (not home_b or id_a < id_b)").where(near).select("id_a", "id_b", "bits_a", "bits_b", "n_a", "n_b")
    few = reps.where(F.col("n") <= int(small / t + 1e-9)).select("id", "bits", "n", "tokens")
    if blocks:  # many rows, but few tokens
        few = few.groupBy("id", "bits", "n").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    few = few.transform(arrow, _small_keys(t), "grp int, key long, id long, bits int, n long, home boolean, guest boolean")
    end = lambda x, role: few.where(role).select("grp", "key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "bits", "n")])
    alike = end("a", "home").join(end("b", "guest"), ["grp", "key"]).where("n_a < n_b or id_a < id_b").select(*met.columns)
    met = met.unionByName(alike).distinct()
    sketch = reps.select("id", "tokens").transform(arrow, _sketches, "id long, " + ", ".join(f"w{i} long" for i in range(SKETCH)))
    if blocks:
        sketch = sketch.groupBy("id").agg(*[F.bit_xor(f"w{i}").alias(f"w{i}") for i in range(SKETCH)])
    side = lambda x: sketch.select(F.col("id").alias(f"id_{x}"), *[F.col(f"w{i}").alias(f"{x}{i}") for i in range(SKETCH)])
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(SKETCH)), F.lit(0))
    bound = F.floor(F.lit((1 - t) / (1 + t)) * (F.col("n_a") + F.col("n_b")) + 1e-9)
    met = met.join(side("a"), "id_a").join(side("b"), "id_b").where(apart <= bound).select("id_a", "id_b", "bits_a", "bits_b", "n_a", "n_b")
    return S.shared(sets, met).where(F.col("both") >= F.lit(t) * (F.col("n_a") + F.col("n_b") - F.col("both")) - 1e-9)


def near_duplicates(df: DataFrame, record: str = "fn_id", parts: tuple[str, ...] = ("a", "rel", "b"), t: float = 0.7) -> DataFrame:
    """(fn_a, fn_b), fn_a < fn_b: all pairs of records whose sets have a Jaccard similarity of at least ``t``.

    Sets are of distinct tuples of ``parts``; rows with a null part or record are left out, empty strings are values,
    repeated rows count once. Records without a valid row have no pair. An empty table gives no rows.
    """
    found = S.token_sets(df, record, parts)
    members, reps = S.classes(found)
    members = cut(members, "members")
    return S.expanded(similar_pairs(found, reps, t), members)


def near_duplicate_groups(df: DataFrame, record: str = "fn_id", parts: tuple[str, ...] = ("a", "rel", "b"), t: float = 0.7) -> DataFrame:
    """One row for each record: fn_id, class_rep (smallest record with an equal set), n_copies, n_links (representatives of other classes that are similar) and group_rep (smallest record of the connected group)."""
    from triloom.operators.graphalg import connected_components

    found = S.token_sets(df, record, parts)
    members, reps = S.classes(found)
    members = cut(members, "members")
    pairs = cut(similar_pairs(found, reps, t).select("id_a", "id_b"), "links")
    ends = pairs.select(F.col("id_a").alias("rep")).unionAll(pairs.select(F.col("id_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    names = members.groupBy("rep").agg(F.min("rec").alias("class_rep"))
    groups = connected_components(pairs, "id_a", "id_b").select(F.col("node").alias("rep"), F.col("component").alias("root"))
    per = names.join(ends, "rep", "left").join(groups, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = per.groupBy("root").agg(F.min("class_rep").alias("group_rep"))
    per = per.join(least, "root").select("rep", "class_rep", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_rep")
    return members.join(per, "rep").select(F.col("rec").alias("fn_id"), "class_rep", F.col("copies").alias("n_copies"), "n_links", "group_rep")
