"""Signatures of fixed functions: triples shared by both versions, lost by the fix, added by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.functions.scalars import graph_key
from triloom.session import cut

#: Signatures whose ids are sent to all tasks, at most (100 bytes each).
NAMES = 250_000
KEY = ["repo", "cve", "hsh", "file", "func"]


def targets(funcs: DataFrame) -> DataFrame:
    """One row for each function version, keyed by its path; of rows loaded again the last counts."""
    last = funcs.where("fn_id is not null and path is not null").groupBy("fn_id").agg(F.max(F.struct("loaded_at", "path", "code")).alias("l"))
    parts = graph_key(F.col("l.path"))
    return last.select("fn_id", *[c.alias(n) for n, c in parts.items() if n != "at"], parts["at"].alias("path"), F.col("l.code").alias("code"))


def pairs(tg: DataFrame) -> DataFrame:
    """(sig_id, repo, cve, hsh, file, func, v_id, p_id): the vulnerable version of a function and its fixed counterpart.

    Of versions with the same key the one with the smallest id counts. ``sig_id`` is the id of the vulnerable version.
    """
    side = lambda role, name: tg.where(F.col("role") == role).groupBy(*KEY).agg(F.min("fn_id").alias(name))
    return side("vuln", "v_id").join(side("patch", "p_id"), KEY).select(F.col("v_id").alias("sig_id"), *KEY, "v_id", "p_id")


def missing(tg: DataFrame) -> DataFrame:
    """Vulnerable versions without a fixed counterpart, with a reason."""
    fixed = tg.where("role = 'patch'").select(*KEY).distinct()
    return tg.where("role = 'vuln'").join(fixed, KEY, "left_anti").select("fn_id", *KEY, F.lit("no patch graph").alias("reason"))


def parts(sig: DataFrame, triples: DataFrame) -> DataFrame:
    """(sig_id, part, a, rel, b): cvg shared, pvg only vulnerable, nvg only fixed. Both sets in one pass over the triples.

    Up to NAMES signatures are sent to the triples, so that only their own rows move; beyond, both sides are laid out.
    """
    sig = cut(sig.select("sig_id", "v_id", "p_id"), "ends")
    ends = sig.select("sig_id", F.col("v_id").alias("fn_id"), F.lit(1).alias("side")).unionByName(sig.select("sig_id", F.col("p_id").alias("fn_id"), F.lit(2).alias("side")))
    ends = F.broadcast(ends) if sig.count() <= NAMES else ends
    rows = triples.where("a is not null and rel is not null and b is not null").join(ends, "fn_id").repartition("sig_id")
    both = rows.groupBy("sig_id", "a", "rel", "b").agg(F.bit_or("side").alias("side"))
    return both.select("sig_id", F.when(F.col("side") == 3, "cvg").when(F.col("side") == 1, "pvg").otherwise("nvg").alias("part"), "a", "rel", "b")


def stats(sig: DataFrame, sig_parts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Sizes of every signature's sets, of rejected ones too; ``ok`` if no part is empty."""
    n = sig_parts.groupBy("sig_id").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("cvg", "pvg", "nvg")])
    out = sig.select("sig_id", "v_id", "p_id").join(n, "sig_id", "left").select("sig_id", "v_id", "p_id", *[F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}") for p in ("cvg", "pvg", "nvg")])
    out = out.withColumns({"n_v": F.col("n_cvg") + F.col("n_pvg"), "n_p": F.col("n_cvg") + F.col("n_nvg"), "ok": (F.col("n_cvg") > 0) & (F.col("n_pvg") > 0) & (F.col("n_nvg") > 0)})
    if nodes is not None:
        per = nodes.groupBy("fn_id").agg(F.count("*").alias("n"))
        for x in ("v", "p"):
            out = out.join(per.select(F.col("fn_id").alias(f"{x}_id"), F.col("n").alias(f"nodes_{x}")), f"{x}_id", "left").withColumn(f"nodes_{x}", F.coalesce(f"nodes_{x}", F.lit(0)))
    return out


def accepted(sig_parts: DataFrame) -> DataFrame:
    """Parts of the signatures in which no part is empty."""
    whole = sig_parts.groupBy("sig_id").agg(F.count_distinct("part").alias("n")).where("n = 3")
    return sig_parts.join(whole, "sig_id", "left_semi")
