"""Verdicts of hits against ground truth that paths encode, and the rates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triloom.functions.scalars import clone_type, is_fixed, is_vulnerable
from triloom.session import arrow

VERDICTS = ("TP", "FP", "TN", "FN", "UNK")


def ground_truth(tg: DataFrame) -> DataFrame:
    """One row: targets by role, and those that should and should not be hit."""
    n = {r: F.count_if(F.col("role") == r) for r in ("vuln", "patch", "before", "after")}
    return tg.agg(*[c.alias(f"n_{r}") for r, c in n.items()], (n["vuln"] + n["before"]).alias("n_vulnerable"), (n["patch"] + n["after"]).alias("n_fixed"))


def with_signature(tg: DataFrame, sig: DataFrame) -> DataFrame:
    """Targets of a CVE and function that have a signature; the repo doesn't matter."""
    return tg.join(sig.select("cve", "func").distinct(), ["cve", "func"], "left_semi")


def with_name(tg: DataFrame, sig: DataFrame) -> DataFrame:
    """Targets whose function name has a signature."""
    return tg.join(sig.select("func").distinct(), "func", "left_semi")


def first_label(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """``hits`` (target_id, sig_id, cve, path) with the verdict of the first label of the CVE whose part the path contains."""
    met = hits.join(labels.select(F.col("cve"), "line_no", "verdict", "path_part"), "cve").where(F.col("path").contains(F.col("path_part")))
    first = met.groupBy("target_id", "sig_id").agg(F.min_by("verdict", "line_no").alias("label"))
    return hits.join(first, ["target_id", "sig_id"], "left")


def verdicts(tg: DataFrame, sig: DataFrame, hits: DataFrame, labels: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(target_id, sig_id, verdict), a row for each hit of a target, and one with a null sig_id for a target without any.

    In this order: the path names the signature's CVE (as a substring, or with ``strict`` as its CVE) and a vulnerable
    role: TP; that CVE and a fixed role: FP; same function name and an earlier version: TP; first matching label; UNK. A
    target without hits is TN in a fixed role, else FN.
    """
    t = tg.select(F.col("fn_id").alias("target_id"), F.col("path"), F.col("func").alias("t_func"), F.col("epoch").alias("t_epoch"), F.col("cve").alias("t_cve"), F.col("role").alias("t_role"))
    s = sig.select("sig_id", "cve", F.col("func").alias("s_func"), F.try_element_at(F.split("hsh", "_"), F.lit(2)).try_cast("long").alias("s_epoch"))
    rows = t.join(hits.select("target_id", "sig_id"), "target_id", "left").join(s, "sig_id", "left")
    if labels is not None:
        rows = first_label(rows, labels)
    label = F.col("label") if labels is not None else F.lit(None).cast("string")
    bad, good = (F.col("t_role").isin("vuln", "before"), F.col("t_role").isin("patch", "after")) if strict else (is_vulnerable(F.col("path")), is_fixed(F.col("path")))
    own = F.col("cve") == F.col("t_cve") if strict else F.col("path").contains(F.col("cve"))
    verdict = (
        F.when(F.col("sig_id").isNull(), F.when(good, "TN").otherwise("FN"))
        .when(own & bad, "TP")
        .when(own & good, "FP")
        .when((F.col("t_func") == F.col("s_func")) & (F.col("t_epoch") < F.col("s_epoch")), "TP")
        .when(label == "TP", "TP")
        .when(label.isNotNull(), "FP")
        .otherwise("UNK")
    )
    return rows.select("target_id", "sig_id", verdict.alias("verdict"), F.col("t_role").alias("role"), "path")


def in_slice(name: str) -> Column:
    """Whether a path is in a slice: all, train (vuln, patch) or test (before, after)."""
    has = lambda *roles: F.greatest(*[F.col("path").contains(f"/{r}/") for r in roles])
    return {"all": F.lit(True), "train": has("vuln", "patch"), "test": has("before", "after")}[name]


def confusion(judged: DataFrame) -> DataFrame:
    """(slice, tp, fp, tn, fn, unk) of the slices all, train and test, counted in one pass."""
    slices = ("all", "train", "test")
    wide = judged.agg(*[F.count_if(in_slice(s) & (F.col("verdict") == v)).alias(f"{s}_{v}") for s in slices for v in VERDICTS])
    cells = ", ".join("'" + s + "', " + ", ".join(f"{s}_{v}" for v in VERDICTS) for s in slices)
    return wide.select(F.expr(f"stack({len(slices)}, {cells}) as (slice, tp, fp, tn, fn, unk)"))


def rates(counts: DataFrame, zero: bool = False) -> DataFrame:
    """Adds precision, recall and F1: nominal, worst (unknown hits are wrong) and best (they are right). Null on an empty denominator, or 0 with ``zero``."""
    tp, fp, fn, unk = (F.col(c) for c in ("tp", "fp", "fn", "unk"))
    out = counts
    for name, hit, wrong in (("nominal", tp, fp), ("worst", tp, fp + unk), ("best", tp + unk, fp)):
        p, r = F.try_divide(hit * 1.0, hit + wrong), F.try_divide(hit * 1.0, hit + fn)
        f1 = F.try_divide(2 * p * r, p + r)
        out = out.withColumns({f"{n}_{name}": F.coalesce(c, F.lit(0.0)) if zero else c for n, c in (("p", p), ("r", r), ("f1", f1))})
    return out


def rate_lines(rated: DataFrame) -> DataFrame:
    """The rates as text, one line for each slice and kind: ``slice kind precision recall f1`` with six decimals; an undefined rate is ``-``."""
    number = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%02f", c))
    line = lambda k: F.concat_ws(" ", "slice", F.lit(k), *[number(f"{m}_{k}") for m in ("p", "r", "f1")])
    return rated.select(F.explode(F.array(*[line(k) for k in ("nominal", "worst", "best")])).alias("value"))


def modified(tg: DataFrame) -> DataFrame:
    """Historic versions (before, after) whose text differs from every original of their CVE and function.

    The original of a before version is vuln, of an after version patch; a version equal to one of them is left out, as is
    one without an original or with null code. Of several originals the one with the largest hash counts. Columns: fn_id,
    role, path, code, original.
    """
    kind = F.when(F.col("role").isin("vuln", "before"), "v").otherwise("p")
    keys = ["repo", "cve", "func", "kind"]
    rows = tg.where("code is not null").withColumn("kind", kind)
    new, old = rows.where(F.col("role").isin("before", "after")), rows.where(F.col("role").isin("vuln", "patch"))
    same = old.select(*keys, F.sha2("code", 256).alias("d")).distinct()
    new = new.withColumn("d", F.sha2("code", 256)).join(same, [*keys, "d"], "left_anti")
    first = old.groupBy(*keys).agg(F.max(F.struct("hsh", "fn_id", "code")).alias("o"))
    return new.join(first, keys).select("fn_id", "role", "path", "code", F.col("o.code").alias("original"))


def line_diff(rows: DataFrame, old: str = "original", new: str = "code") -> DataFrame:
    """Adds added, removed and n_original: lines a minimal line diff adds and removes, and newlines of the old text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            pairs = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (old, new)))
            out = [(None, None, None) if x is None or y is None else _diff(x, y) for x, y in pairs]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(list(c), pa.int32()) for c in cols]], [*b.schema.names, "added", "removed", "n_original"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return rows.transform(arrow, run, StructType([*rows.schema.fields, *[StructField(c, IntegerType()) for c in ("added", "removed", "n_original")]]))


def _diff(old: str, new: str) -> tuple[int, int, int]:
    a, b = old.splitlines(), new.splitlines()
    n = old.count("\n")
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    # longest common subsequence by matching positions, each old line's places in descending order (Hunt and Szymanski)
    from bisect import bisect_left

    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list[int] = []
    for x in a:
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
    return len(b) - len(tails), len(a) - len(tails), n


def clone_types(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("clone_type", clone_type(F.col("added"), F.col("removed"), F.col("n_original")))


def modified_verdicts(changed: DataFrame, sig: DataFrame, hits: DataFrame) -> DataFrame:
    """One verdict for each modified target: a hit of a CVE that its path names counts by role, none is TN or FN."""
    own = changed.join(hits.select(F.col("target_id").alias("fn_id"), "sig_id"), "fn_id").join(sig.select("sig_id", "cve"), "sig_id").where(F.col("path").contains(F.col("cve")))
    hit = own.select("fn_id", F.lit(True).alias("hit")).distinct()
    bad = is_vulnerable(F.col("path"))
    verdict = F.when(F.col("hit"), F.when(bad, "TP").otherwise("FP")).otherwise(F.when(is_fixed(F.col("path")), "TN").otherwise("FN"))
    return changed.join(hit, "fn_id", "left").withColumn("verdict", verdict).drop("hit")


