"""Column builders: paths, similarities, decisions. All are built-in expressions and stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triloom.operators.compact import resolved


def path_part(path: Column, back: int) -> Column:
    """The component of a path that is ``back`` places from its end (1 is the last); null if there are too few."""
    return F.try_element_at(F.split(path, "/"), F.lit(-back))


def graph_key(path: Column) -> dict[str, Column]:
    """Key columns that the layout ``<root>/<repo>/<cve>/<role>/<hash>_<epoch>/<file>/graph/<func>.gpickle`` encodes."""
    at = resolved(path)
    hsh = path_part(at, 4)
    return {
        "repo": path_part(at, 7), "cve": path_part(at, 6), "role": path_part(at, 5), "hsh": hsh, "file": path_part(at, 3),
        "func": F.regexp_replace(path_part(at, 1), r"\.gpickle$", ""), "epoch": epoch(hsh), "at": at,
    }


def source_key(path: Column, below: int = 0) -> dict[str, Column]:
    """Key columns of the layout ``<root>/<repo>/<cve>/<role>/<hash>_<epoch>/<file>``, with ``below`` more parts after it."""
    at = resolved(path)
    return {name: path_part(at, below + k) for name, k in (("repo", 5), ("cve", 4), ("role", 3), ("hsh", 2), ("file", 1))}


def epoch(hsh: Column) -> Column:
    """Seconds from ``<hash>_<epoch>``."""
    return F.try_element_at(F.split(hsh, "_"), F.lit(2)).try_cast("long")


def extension(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end``, from 0, the end included."""
    return F.substring(text, start.cast("int") + 1, (end - start + 1).cast("int"))


def char_set(s: Column) -> Column:
    return F.array_distinct(F.split(s, ""))


def char_masks(s: Column) -> Column:
    """A string's character set for fast comparison: bit masks of the ASCII characters, the other ones, and the set's size."""
    chars = F.filter(char_set(s), lambda c: c != "")
    code = lambda c: F.ascii(c)
    mask = lambda low: F.aggregate(F.filter(chars, lambda c: (code(c) >= low) & (code(c) < low + 64)), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), code(c) - low)))
    return F.struct(mask(0).alias("lo"), mask(64).alias("hi"), F.filter(chars, lambda c: code(c) >= 128).alias("rest"), F.size(chars).alias("n"))


def mask_similarity(a: str, b: str) -> Column:
    """Jaccard similarity of the character sets in the :func:`char_masks` columns ``a`` and ``b``; two empty ones are equal."""
    bits = F.bit_count(F.col(f"{a}.lo").bitwiseAND(F.col(f"{b}.lo"))) + F.bit_count(F.col(f"{a}.hi").bitwiseAND(F.col(f"{b}.hi")))
    rest = F.when((F.size(f"{a}.rest") > 0) & (F.size(f"{b}.rest") > 0), F.size(F.array_intersect(f"{a}.rest", f"{b}.rest"))).otherwise(0)
    both, n = bits + rest, F.col(f"{a}.n") + F.col(f"{b}.n")
    return F.when(n == 0, F.lit(1.0)).otherwise(both / (n - both))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two strings' character sets; 1 for equal strings, empty ones included."""
    return F.when(a == b, F.lit(1.0)).otherwise(set_similarity(F.filter(char_set(a), lambda c: c != ""), F.filter(char_set(b), lambda c: c != "")))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double; null for an empty whole."""
    return F.try_divide(part * 100.0, whole)


def is_scan_hit(cvg: Column, pvg: Column, nvg: Column, c: float = 50, p: float = 50, n: float = 50) -> Column:
    """The scanner's decision, strict on all sides."""
    return (cvg > c) & (pvg > p) & (nvg < n)


def is_eval_hit(cvg: Column, pvg: Column, nvg: Column, c: float = 25, p: float = 60) -> Column:
    """The evaluator's decision."""
    return (cvg >= c) & (pvg >= p) & (pvg > nvg)


def is_vulnerable(path: Column) -> Column:
    """By substring, as labels are read from paths: a root directory that looks like a role counts too."""
    return path.contains("/vuln/") | path.contains("/before/")


def is_fixed(path: Column) -> Column:
    return path.contains("/patch/") | path.contains("/after/")


def clone_type(added: Column, removed: Column, original: Column) -> Column:
    """2 if as many lines were added as removed, else 4 if more than half of the original changed, else 3."""
    return F.when(added == removed, 2).when(added + removed > F.floor(original * 0.5), 4).otherwise(3)
