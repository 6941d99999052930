"""Signatures laid out in blocks in the shared folder, and targets that stream past them: no row for a triple that two share.

A triple is known by 96 bits of hashes. Of the signatures' part rows a block of whole signatures is written once, so a target
moves once, whatever the number of blocks. A task gathers a chunk of targets and takes one block after the other for it.

With a bound, only those signatures are scored of which a target holds one of the n - m + 1 triples that fewest signatures
have: a target that holds m of n triples holds one of any n - m + 1. Which they are decides the work, never the result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.session import address, arrow, scratch

#: Rows of signatures in a block and of targets in a chunk, about.
BLOCK, CHUNK = 1_000_000, 2_000_000
#: Targets whose rows stand together by signature, so that files repeat names within what a codec looks back on; rows in a batch, and rows that are held for that order at most, about.
SIDE, ROWS, MOST = 16, 50_000, 1_000_000
PARTS = ("cvg", "pvg", "nvg")


def _key(*c: str) -> list:
    known = F.col(c[0]).isNotNull() & F.col(c[1]).isNotNull() & F.col(c[2]).isNotNull()
    return [F.when(known, F.xxhash64(*c)).alias("k1"), F.when(known, F.hash(*c)).alias("k2")]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one target in a row or nearby become one row with its distinct keys."""
    for t in _gathered(batches, 200_000):
        who = t.column(0).combine_chunks().dictionary_encode()
        names, code = who.dictionary, who.indices.to_numpy()
        code, k1, k2 = _distinct(code, t.column(1).to_numpy(), t.column(2).to_numpy())
        ends = np.cumsum(np.bincount(code, minlength=len(names))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), pa.array(k)) for k in (k1, k2)]
        yield pa.RecordBatch.from_arrays([names, *lists], ["id", "k1", "k2"])


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= n:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _distinct(code: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((k2, k1, code))
    code, k1, k2 = code[order], k1[order], k2[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])][: len(code)]
    return code[new], k1[new], k2[new]


def _built(uri: str, made: Callable):
    """Rows come with each block's together; a block is ``made`` of them once, and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(address(uri))

        def stored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = made(pa.Table.from_batches(held))
            name = uuid.uuid4().hex  # each attempt has files of its own
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}") as f:
                pickle.dump(block, f, 5)
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            at = b.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    if held and held[-1].column(0)[0].as_py() != at[lo]:
                        yield stored(held)
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield stored(held)

    return run


def _listed(lists: Callable):
    """A block with the ``lists`` of it that pairs are found by."""

    def made(t: pa.Table) -> _Block:
        block = _Block(t)
        block.lists = lists(block)
        return block

    return made


class _Block:
    def __init__(self, t: pa.Table):
        who = t.column("sig_id").combine_chunks().dictionary_encode()
        self.n = len(who.dictionary)
        code, part, k1, k2 = who.indices.to_numpy(), *(t.column(c).combine_chunks() for c in ("part", "k1", "k2"))
        known, part = k1.is_valid().to_numpy(zero_copy_only=False), part.to_numpy()
        k1, k2 = (x.fill_null(0).to_numpy() for x in (k1, k2))
        cell = code * np.int64(3) + part
        self.size = np.bincount(cell, minlength=3 * self.n).reshape(-1, 3)
        first = np.full(self.n, -1)
        first[code[::-1]] = np.arange(len(code))[::-1]
        self.label = t.column("label").combine_chunks().take(pa.array(first))
        rows = np.flatnonzero(known)
        rows = rows[np.lexsort((k2[rows], k1[rows]))]
        a, b = k1[rows], k2[rows]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(rows)]
        self.k1, self.k2 = a[new], b[new]
        # how many keys may have the same first half
        self.same = 1 + max((int(x) for x in np.diff(np.flatnonzero(np.r_[True, self.k1[1:] != self.k1[:-1], True]))), default=0) - 1 if len(self.k1) else 0
        self.none = len(self.k1)
        which = np.full(len(code), self.none)
        which[rows] = np.cumsum(new) - 1
        order = np.argsort(cell, kind="stable")
        self.cell, self.which = cell[order], which[order]
        self.ends = np.r_[0, np.cumsum(self.size.ravel())]

    def posted(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each triple the (start, end) of its cells, and the cells; of those rows only that are to be kept."""
        on = self.which < self.none
        if keep is not None:
            on &= keep
        which, cell = self.which[on], self.cell[on]
        order = np.argsort(which, kind="stable")
        return np.r_[0, np.cumsum(np.bincount(which, minlength=self.none))], cell[order]

    def rare(self, part: int, least: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the n - least(n) + 1 triples of each signature's part that fewest signatures of the block have."""
        own = np.flatnonzero(self.cell % 3 == part)
        df = np.r_[np.bincount(self.which, minlength=self.none + 1)[: self.none], 0]
        own = own[np.lexsort((self.which[own], df[self.which[own]], self.cell[own]))]
        n = self.size[:, part]
        sig = self.cell[own] // 3
        rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.zeros(len(self.cell), bool)
        keep[own[rank < (n - least(n) + 1)[sig]]] = True
        return self.posted(keep)

    def found(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The triple of each key, or ``none``."""
        at, out = np.searchsorted(self.k1, k1), np.full(len(k1), self.none)
        for step in range(self.same):
            i = np.minimum(at + step, self.none - 1)
            hit = (self.k1[i] == k1) & (self.k2[i] == k2)
            out[hit] = i[hit]
        return out


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0] .. hi[0] - 1, lo[1] .. hi[1] - 1, and so on."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def _percent(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return n * 100.0 / size  # of an empty part: not a number


def _every(block: _Block, code: np.ndarray, which: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(target, signature, counts) of all pairs that share a triple."""
    starts, cells = block.lists
    edges = np.searchsorted(code, np.arange(n + 1))
    for t in range(n):
        own = which[edges[t] : edges[t + 1]]
        if len(own):
            both = np.bincount(cells[_spans(starts[own], starts[own + 1])], minlength=3 * block.n).reshape(-1, 3)
            sig = np.flatnonzero(both.any(axis=1))
            yield np.full(len(sig), t), sig, both[sig]


def _bounded(block: _Block, code: np.ndarray, which: np.ndarray, n: int, count: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """(target, signature, counts) of the pairs that the bound leaves; without ``count`` no counts."""
    starts, cells = block.lists
    step = max(1, 4_000_000 // (block.n + 1))
    edges = np.searchsorted(code, np.arange(n + 1))
    mark = np.zeros(block.none + 1, bool)
    for first in range(0, n, step):
        lo, hi = edges[first], edges[min(n, first + step)]
        met = np.zeros((min(n, first + step) - first, block.n), bool)
        on = which[lo:hi]
        met[np.repeat(code[lo:hi] - first, starts[on + 1] - starts[on]), cells[_spans(starts[on], starts[on + 1])] // 3] = True
        near, sig = np.nonzero(met)
        if not count:
            yield near + first, sig, np.zeros((len(sig), 3), np.int64)
            continue
        bounds = np.searchsorted(near, np.arange(len(met) + 1))
        for t in np.flatnonzero(np.diff(bounds)):
            mine, own = sig[bounds[t] : bounds[t + 1]], which[edges[first + t] : edges[first + t + 1]]
            mark[own] = True
            for at in range(0, len(mine), 20_000):
                some = mine[at : at + 20_000]
                begin, end = block.ends[3 * some], block.ends[3 * some + 3]
                upto = np.r_[0, np.cumsum(mark[block.which[_spans(begin, end)]])]
                base = (np.cumsum(end - begin) - (end - begin))[:, None] - begin[:, None]
                cuts = upto[block.ends[3 * some[:, None] + np.arange(4)] + base]
                yield np.full(len(some), first + t), some, np.diff(cuts, axis=1)
            mark[own] = False


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of (target, list of ``chunk`` members in all, about, ...), those of a target together; a chunk ends where a target does."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= chunk:
            new = np.asarray(pc.not_equal(b.column(0), held[-1].column(0)[-1]))
            at = int(np.argmax(new)) if new.any() else b.num_rows
            if at < b.num_rows:
                if at:
                    held.append(b.slice(0, at))
                yield held
                held, n, b = [], 0, b.slice(at)
        held.append(b)
        n += len(b.column(1).flatten())
    if held:
        yield held


def _run(uri: str, blocks: list[str], chunk: int, pairs: Callable, made: Callable):
    """``pairs`` gives the pairs of a block and a chunk, ``made`` turns them into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(address(uri))
        last: list = [None, None]

        def block(b: str) -> _Block:
            if last[0] != b:
                last[1] = None
                with system.open_input_stream(f"{base}/{b}") as f:
                    last[:] = b, pickle.load(f)
            return last[1]

        def scored(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            who = t.column(0).combine_chunks()
            new = np.r_[True, np.asarray(pc.not_equal(who[1:], who[:-1]))] if len(who) > 1 else np.ones(len(who), bool)
            code = np.cumsum(new) - 1
            labels = t.column(3).combine_chunks().take(pa.array(np.flatnonzero(new)))
            k1, k2 = (t.column(i).combine_chunks() for i in (1, 2))
            code = np.repeat(code, np.asarray(pc.list_value_length(k1)))
            code, k1, k2 = _distinct(code, k1.flatten().to_numpy(), k2.flatten().to_numpy())
            for b in sorted(blocks, key=lambda b: b != last[0]):  # the one at hand first
                x = block(b)
                which = x.found(k1, k2)
                on = which < x.none
                yield from made(x, labels, pairs(x, code[on], which[on], len(labels)))

        for held in _chunks(batches, chunk):
            yield from scored(held)

    return run


def _rows(keep: Callable | None, empty: float | None):
    """Rows (sig_id, target_id, cvg, pvg, nvg) of the pairs that ``keep`` takes; an empty part scores ``empty``."""

    def made(block: _Block, labels: pa.Array, pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            who, sig, *values = (np.concatenate(x) for x in zip(*held))
            order = np.argsort((who // SIDE * block.n + sig) * SIDE + who % SIDE, kind="stable")
            for at in range(0, len(order), ROWS):
                on = order[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([block.label.take(pa.array(sig[on])), labels.take(pa.array(who[on])), *[pa.array(v[on], pa.float64(), from_pandas=True) for v in values]], ["sig_id", "target_id", *PARTS])

        for who, sig, both in pairs:
            p = _percent(both, block.size[sig])
            if empty is not None:
                p[block.size[sig] == 0] = empty
            if keep is not None:
                on = keep(p[:, 0], p[:, 1], p[:, 2])
                who, sig, p = who[on], sig[on], p[on]
            if n >= MOST or n >= ROWS and len(who) and who[0] // SIDE > held[-1][0][-1] // SIDE:
                yield from flush()
                held, n = [], 0
            if len(sig):
                held.append((who, sig, p[:, 0], p[:, 1], p[:, 2]))
                n += len(sig)
        if n:
            yield from flush()

    return made


def _streamed(sig_parts: DataFrame, triples: DataFrame, lists: Callable, pairs: Callable, made: Callable, schema: str, names: DataFrame | None, paths: DataFrame | None, block: int | None, chunk: int | None) -> DataFrame:
    block, chunk = block or BLOCK, chunk or CHUNK
    rows = sig_parts.where("sig_id is not null")
    if names is not None:
        rows = rows.join(names.select("sig_id", F.col("name").alias("label")), "sig_id")
    number = F.when(F.col("part") == "cvg", 0).when(F.col("part") == "pvg", 1).when(F.col("part") == "nvg", 2)
    blocks = -(-max(1, sig_parts.count()) // block)
    rows = rows.select(F.pmod(F.xxhash64("sig_id"), F.lit(blocks)).cast("int").alias("block"), "sig_id", *(["label"] if names is not None else [F.col("sig_id").alias("label")]), number.alias("part"), *_key("a", "rel", "b")).where("part is not null")
    at = scratch(sig_parts.sparkSession, "blocks")
    there = [r.name for r in rows.repartitionById(blocks, "block").sortWithinPartitions("block", "sig_id").transform(arrow, _built(at, _listed(lists)), "name string").collect()]
    tg = triples.where("fn_id is not null").select(F.col("fn_id").alias("id"), *_key("a", "rel", "b")).where("k1 is not null")
    tg = tg.transform(arrow, _bags, "id string, k1 array<long>, k2 array<int>").repartition("id")
    if paths is not None:
        tg = tg.join(paths.select(F.col("fn_id").alias("id"), F.col("path").alias("label")), "id")
    tg = tg.select("id", "k1", "k2", F.col("label") if paths is not None else F.col("id").alias("label")).sortWithinPartitions("id")
    return tg.transform(arrow, _run(at, sorted(there), chunk, pairs, made), schema)


_SCORES = "sig_id string, target_id string, cvg double, pvg double, nvg double"


def scores(sig_parts: DataFrame, triples: DataFrame, names: DataFrame | None = None, paths: DataFrame | None = None, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """(sig_id, target_id, cvg, pvg, nvg) of all pairs that share a triple; the score of an empty part is null.

    With ``names`` (sig_id, name) and ``paths`` (fn_id, path) those stand in place of the ids, and what has none is left out.
    """
    return _streamed(sig_parts, triples, _Block.posted, _every, _rows(None, None), _SCORES, names, paths, block, chunk)


def hits(sig_parts: DataFrame, triples: DataFrame, part: str, least: Callable, keep: Callable) -> DataFrame:
    """Scores of the pairs that ``keep`` takes (a function of the three scores), if they hold ``least(n)`` of the n triples of ``part``."""
    p = PARTS.index(part)
    return _streamed(sig_parts, triples, lambda b: b.rare(p, least), _bounded, _rows(keep, 0.0), _SCORES, None, None, None, None)


def candidates(sig_parts: DataFrame, triples: DataFrame, part: str, least: Callable) -> DataFrame:
    """(sig_id, target_id): the pairs that the bound leaves, before any is scored."""
    p = PARTS.index(part)
    return _streamed(sig_parts, triples, lambda b: b.rare(p, least), lambda *x: _bounded(*x, False), _rows(None, None), _SCORES, None, None, None, None).select("sig_id", "target_id")


def cells(sig_parts: DataFrame, triples: DataFrame, step: int) -> DataFrame:
    """(c, p, n): how many pairs whose pvg is above their nvg have cvg and pvg in which steps; pairs are counted where they are scored."""

    def made(block: _Block, labels: pa.Array, pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        top = 100 // step
        n = np.zeros((top + 1) ** 2, np.int64)
        for _, sig, both in pairs:
            on = both[:, 1] > 0
            score = _percent(both[on], block.size[sig[on]])
            score = score[(score[:, 1] > score[:, 2]) & ~np.isnan(score[:, 0])]
            c, p = (np.floor(score[:, k] / step).astype(np.int64) for k in (0, 1))
            n += np.bincount(c * (top + 1) + p, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at // (top + 1), at % (top + 1), n[at])], ["c", "p", "n"])

    each = _streamed(sig_parts, triples, _Block.posted, _every, made, "c long, p long, n long", None, None, None, None)
    return each.groupBy("c", "p").agg(F.sum("n").alias("n"))
