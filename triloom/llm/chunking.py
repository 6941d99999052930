"""Splitting of oversized texts at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary within the middle half of its tokens, the one nearest the
midpoint among equals (if only blanks are there, at the sentence end nearest the midpoint further out); halves still over the limit less the overlap are cut again; then every piece but the first is
given the last tokens of the piece before it. Texts are independent, so the plan has no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.tokens import line_ends, token_spans
from triloom.session import arrow, col

#: Strengths of the boundary before a token.
NONE, GAP, SENTENCE, LINE, PARAGRAPH = range(5)
_BLANK = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\r\n]*\r")
_STOPS = frozenset(".!?…。！？")
_CLOSING = "\"')]}»”’"


def split_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 900, overlap: int = 60, with_text: bool = True) -> DataFrame:
    """The pieces of every text of more than ``limit`` tokens.

    Columns: doc_id, piece_no (from 0), n_pieces, start and stop (characters, stop excluded), core_start (where the
    piece goes on after the overlap), n_tokens, n_overlap, boundary (of the cut before it) and, if wanted, text. The
    parts from core_start to stop make up the whole text. Texts within the limit, null and empty ones give no row; a
    text is cut within a sentence only where no sentence, line or paragraph ends more than the overlap from its ends.
    Repeated rows are each cut. Other columns of ``df`` are not carried along.
    """
    if not 0 <= overlap * 4 < limit:
        raise ValueError("the overlap must be below a quarter of the limit")
    long = df.select(col(df, doc_id).alias("doc_id"), col(df, text).alias("text")).where(F.length("text") > limit)
    schema = f"doc_id {dict(long.dtypes)['doc_id']}, piece_no int, n_pieces int, start long, stop long, core_start long, n_tokens int, n_overlap int, boundary string" + ", text string" * with_text
    return long.transform(arrow, _splitter(limit, overlap, with_text), schema)


def boundaries(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The strength of the boundary before each token."""
    strength = np.where(np.r_[False, starts[1:] > ends[:-1]], GAP, NONE).astype(np.uint8)
    lines = line_ends(text)
    broken = np.flatnonzero(np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, ends[:-1])) + 1
    strength[broken] = LINE
    for i in broken:
        if _BLANK.search(text, ends[i - 1], starts[i]):
            strength[i] = PARAGRAPH
    for i in np.flatnonzero(strength == GAP):
        if text[ends[i - 1] - 1] in _STOPS or (text[starts[i - 1] : ends[i - 1]].rstrip(_CLOSING)[-1:] or " ") in _STOPS:
            strength[i] = SENTENCE
    return strength


def bisect(strength: np.ndarray, n: int, limit: int, overlap: int) -> list[int]:
    """Where the pieces of ``n`` tokens begin."""
    if n <= limit:
        return [0]
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            out.append(a)
            continue
        quarter = max(1, (b - a) // 4)
        near = strength[a + quarter : b - quarter + 1]
        if near.max() < SENTENCE and (strength[a + overlap + 1 : b - overlap] >= SENTENCE).any():
            quarter = overlap + 1  # no natural place in the middle half, but one further out
            near = np.minimum(strength[a + quarter : b - overlap], SENTENCE)
        best = np.flatnonzero(near == near.max())
        cut = a + quarter + int(best[np.argmin(np.abs(best + quarter - (b - a) / 2))])
        todo += [(cut, b), (a, cut)]
    return out


def _splitter(limit: int, overlap: int, with_text: bool):
    labels = ["none", "gap", "sentence", "line", "paragraph"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                starts, ends = token_spans(text)
                n = len(starts)
                if n <= limit:
                    continue
                strength = boundaries(text, starts, ends)
                firsts = bisect(strength, n, limit, overlap)
                for k, first in enumerate(firsts):
                    end = firsts[k + 1] if k + 1 < len(firsts) else n
                    back = max(0, first - overlap) if k else 0
                    core = int(starts[first]) if k else 0
                    start = int(starts[back]) if k else 0
                    stop = int(starts[end]) if end < n else len(text)
                    rows.append((k, len(firsts), start, stop, core, end - back, first - back, labels[strength[first]] if k else "start", *[text[start:stop]] * with_text))
                    at.append(i)
            cols = list(zip(*rows)) or [()] * (8 + with_text)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            names = ["piece_no", "n_pieces", "start", "stop", "core_start", "n_tokens", "n_overlap", "boundary", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types)]], ["doc_id", *names[: len(cols)]])

    return run
