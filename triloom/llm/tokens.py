"""Tokens and words of texts, cut as vectors of code points.

A token is a maximal run of letters, digits and ``_``, or a maximal run of other characters that are not white space.
A word is a maximal run of letters and digits in lower case.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Python's ``str.isspace`` accepts, as a class of Java's regular expressions.
JAVA_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
JAVA_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{JAVA_SPACE}]+"

SPACE, WORD, UNDERSCORE, OTHER = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            out[i] = WORD
        elif c.isspace():
            out[i] = SPACE
    out[ord("_")] = UNDERSCORE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Characters that are looked at together; bounds the memory that a very long text takes.
SLICE = 4_000_000


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in characters, of the tokens of ``text``."""
    before = SPACE
    at: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    for lo in range(0, len(text), SLICE):
        kind = classes()[code_points(text[lo : lo + SLICE])]
        kind[kind == UNDERSCORE] = WORD
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(before)) != 0)
        at.append(edge + lo)
        kinds.append(kind[edge])
        before = kind[-1]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges, first = np.concatenate([*at, [len(text)]]).astype(np.int64), np.concatenate(kinds)
    keep = first != SPACE
    return edges[:-1][keep], edges[1:][keep]


def line_ends(text: str) -> np.ndarray:
    """Places of line feeds and carriage returns."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(text), SLICE):
        points = code_points(text[lo : lo + SLICE])
        out.append(np.flatnonzero((points == 10) | (points == 13)) + lo)
    return np.concatenate(out)


def n_tokens(text: Column) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(JAVA_TOKEN)), F.lit(0)).cast("long")
