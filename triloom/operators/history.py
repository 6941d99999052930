"""Mining of version history: commits, diffs, and versions before and after a fix."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triloom.session import arrow, cut

MONTH, HALF_YEAR = 2_592_000, 15_552_000  # 30 and 180 days, in seconds
#: What is taken from the lines of a diff. File name, path with the ``a/`` before it, blob ids, names before a bracket.
FILE_NAME = r"[a-zA-Z0-9_]*\.c[pp]*"
FILE_PATH = r"a/[/a-zA-Z0-9_-]*\.c[pp]*"
BLOB_IDS = r"^index ([a-z0-9]*)\.\.([a-z0-9]*)"
CALLED = r"([a-zA-Z0-9_]*)\("
#: Roots that are followed at once through the commits of a repo.
ROOTS = 4096
#: Commits after which it is seen which roots nothing more can be found for, at least.
TIDY = 4_000


def cve_commits(commits: DataFrame) -> DataFrame:
    """Commits that aren't merges and whose message names a CVE; adds the first such id. Of a message without an id, nothing."""
    found = commits.where(~F.col("is_merge") & F.col("message").contains("CVE-20"))
    return found.withColumn("cve", F.regexp_extract("message", r"CVE-[0-9]*-[0-9]*", 0)).where("cve <> ''")


def not_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental runs: rows whose keys aren't there yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def file_counts(diff_lines: DataFrame, keys: list[str]) -> DataFrame:
    return diff_lines.groupBy(*keys).agg(F.count_if(F.col("line").startswith("diff --git")).alias("n_files"))


def small_commits(diff_lines: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Commits that change 1 to ``most`` files."""
    return file_counts(diff_lines, keys).where(F.col("n_files").between(1, most))


def mined(diff_lines: DataFrame, keys: list[str], done: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(keys, n_files, cve, reason): every commit with the first CVE id in its text; ``reason`` says why it is skipped, or is null.

    ``done`` (cve and some of the keys) has what earlier runs covered. Commits that change no file or more than ``most``
    are skipped, as are those that name no CVE.
    """
    found = F.regexp_extract("line", r"CVE-[0-9]*-[0-9]*", 0)
    per = diff_lines.groupBy(*keys).agg(F.count_if(F.col("line").startswith("diff --git")).alias("n_files"), F.min_by(found, F.when(found != "", F.col("line_no"))).alias("cve"))
    covered = F.lit(False)
    if done is not None:
        on = [c for c in done.columns if c == "cve" or c in keys]
        per = per.join(done.select(*on).distinct().withColumn("_done", F.lit(True)), on, "left")
        covered = F.coalesce("_done", F.lit(False))
    reason = F.when(F.col("n_files") == 0, "no file").when(F.col("n_files") > most, "too many files").when(F.col("cve").isNull(), "no CVE").when(covered, "CVE covered already")
    return per.select(*keys, "n_files", "cve", reason.alias("reason"))


def counters(mined_commits: DataFrame, by: list[str]) -> DataFrame:
    """Commits processed and skipped."""
    return mined_commits.groupBy(*by).agg(F.count_if(F.col("reason").isNull()).alias("n_processed"), F.count_if(F.col("reason").isNotNull()).alias("n_skipped"))


def parse_diffs(diff_lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, file, path, old_id, new_id, funcs): one row for each changed C or C++ file with function names.

    A ``diff --git`` line opens a segment and names its file; a file of another kind has no name and no row. ``index``
    lines give the blob ids, and ``@@`` lines after both ids the name of the last function before a bracket. Blanks
    around lines don't count. ``line_no`` may be of any type that has an order.
    """
    line = F.trim("line")
    opens = line.startswith("diff --git")
    ids = F.when(line.rlike(BLOB_IDS), F.struct(F.regexp_extract(line, BLOB_IDS, 1).alias("old"), F.regexp_extract(line, BLOB_IDS, 2).alias("new")))
    names = F.when(line.contains("@@"), F.try_element_at(F.regexp_extract_all(line, F.lit(CALLED), F.lit(1)), F.lit(-1)))
    # lines that say nothing don't reach the windows
    said = diff_lines.select(*keys, "line_no", F.when(opens, line).alias("head"), F.when(~opens, ids).alias("ids"), F.when(~opens, names).alias("func"))
    said = said.where("head is not null or ids is not null or func <> ''")
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = said.withColumn("segment", F.count("head").over(upto)).where("segment > 0")
    within = Window.partitionBy(*keys, "segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = said.withColumn("at", F.last("ids", ignorenulls=True).over(within))
    known = (F.col("at.old") != "") & (F.col("at.new") != "")
    per = said.groupBy(*keys, "segment").agg(F.max("head").alias("head"), F.max_by("at", "line_no").alias("at"), F.array_sort(F.collect_set(F.when(known, F.col("func")))).alias("funcs"))
    out = per.select(*keys, "segment", F.regexp_extract("head", FILE_NAME, 0).alias("file"), F.substring(F.regexp_extract("head", FILE_PATH, 0), 3, 1 << 20).alias("path"), F.col("at.old").alias("old_id"), F.col("at.new").alias("new_id"), F.filter("funcs", lambda x: x != "").alias("funcs"))
    return out.where((F.col("file") != "") & (F.size("funcs") > 0))


def with_versions(changed: DataFrame, blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Both versions of changed files by blob id: (keys, file, path, role, content). ``changed`` as :func:`parse_diffs` gives it, ``blobs``: blob_id, content.

    Diffs shorten ids, so a blob is found by the part that is given; of several the smallest id counts.
    """
    ends = F.array(F.struct(F.lit("vuln").alias("role"), F.col("old_id").alias("short")), F.struct(F.lit("patch").alias("role"), F.col("new_id").alias("short")))
    wanted = changed.select(*keys, "file", "path", F.inline(ends)).withColumn("n", F.length("short"))
    lengths = wanted.select("n").distinct()  # a handful
    cut_to = blobs.join(F.broadcast(lengths), F.length("blob_id") >= F.col("n")).groupBy(F.substring("blob_id", F.lit(1), F.col("n")).alias("short")).agg(F.min("blob_id").alias("blob_id"))
    return wanted.join(cut_to, "short").join(blobs.select("blob_id", "content"), "blob_id").select(*keys, "file", "path", "role", "content")


def versions_at(wanted: DataFrame, tree: DataFrame, keys: list[str]) -> DataFrame:
    """Contents of (commit, path): ``wanted`` has keys, commit, path, role; ``tree`` has commit, path, content."""
    return wanted.join(tree.select("commit", "path", "content"), ["commit", "path"]).select(*keys, "commit", "path", "role", "content")


def first_productive(commits: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Of the productive commits of each group the first by ``order``."""
    return commits.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def _spread(commits: DataFrame, path: str, ts: str, seq: str, ahead: bool) -> DataFrame:
    """Commits laid out by path and half-year, so that a path with most of all commits isn't ordered in one task.

    A part holds the commits of its half-year (``_own``), those of the half-year before it (with ``ahead``: after it), and
    the three commits next to these on the far side: all that the look-ups of its own commits can reach. Only three
    commits of each half-year are gathered to find the latter. Adds ``_blk`` and ``_own``.
    """
    rows = commits.select(path, ts, seq).withColumn("_blk", F.floor(F.col(ts) / HALF_YEAR))
    step = 1 if ahead else -1
    edge = Window.partitionBy(path, "_blk").orderBy(*([F.col(ts), F.col(seq)] if ahead else [F.desc(ts), F.desc(seq)]))
    ends = rows.withColumn("_r", F.row_number().over(edge)).where("_r <= 3").groupBy(path, "_blk").agg(F.sort_array(F.collect_list(F.struct(ts, seq))).alias("_ends"))
    frame = (2, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -2)
    far = F.sort_array(F.flatten(F.collect_list("_ends").over(Window.partitionBy(path).orderBy("_blk").rangeBetween(*frame))))  # three for each half-year
    seen = F.col("_far")
    three = F.slice(seen, 1, 3) if ahead else F.slice(seen, F.greatest(F.lit(1), F.size(seen) - 2), 3)
    carried = ends.withColumn("_far", far).select(path, "_blk", F.inline(three)).withColumn("_own", F.lit(False))
    near = rows.select(path, ts, seq, (F.col("_blk") - step).alias("_blk")).join(ends.select(path, "_blk"), [path, "_blk"], "left_semi").withColumn("_own", F.lit(False))
    return rows.withColumn("_own", F.lit(True)).unionByName(near).unionByName(carried)


def versions_before(commits: DataFrame, path: str = "path", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """For each commit of a path: the one before it, the newest at least 30 days older, and the newest at least 180 days older.

    No two of them are the same commit, and each is looked for only if the one before was found. As-of lookups are
    maxima over growing frames of a window, in linear time and without a self-join. Columns: path, ts, seq,
    before_seq, before_1mo_seq, before_6mo_seq.
    """
    keys = [path, "_blk"]
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    rows = _spread(commits, path, ts, seq, ahead=False).select(*keys, ts, seq, "_own", *[F.lag(seq, k).over(w).alias(f"_{k}") for k in (1, 2)])
    at = lambda gap: F.max(F.struct(ts, seq, "_1", "_2")).over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, -gap))
    rows = rows.withColumns({"_m": at(MONTH), "_h": at(HALF_YEAR)}).where("_own")
    pick = lambda s, *taken: F.filter(F.array(s[seq], s["_1"], s["_2"]), lambda x: x.isNotNull() & ~F.coalesce(F.array_contains(F.array(*taken), x), F.lit(False)))
    first = lambda a: F.try_element_at(a, F.lit(1))
    rows = rows.withColumn("before_seq", F.col("_1"))
    rows = rows.withColumn("before_1mo_seq", F.when(F.col("before_seq").isNotNull(), first(pick(F.col("_m"), F.col("before_seq")))))
    rows = rows.withColumn("before_6mo_seq", F.when(F.col("before_1mo_seq").isNotNull(), first(pick(F.col("_h"), F.col("before_seq"), F.col("before_1mo_seq")))))
    return rows.select(path, ts, seq, "before_seq", "before_1mo_seq", "before_6mo_seq")


def versions_after(commits: DataFrame, path: str = "path", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """For each commit of a path: the next one, and the ones that follow the newest within 30 and within 180 days.

    Where no later commit is within the time, the oldest that isn't taken yet. The one of 180 days may be that of 30 days.
    Each is looked for only if the one before was found. Columns: path, ts, seq, after_seq, after_1mo_seq, after_6mo_seq.
    """
    keys = [path, "_blk"]
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    rows = _spread(commits, path, ts, seq, ahead=True).select(*keys, ts, seq, "_own", *[F.lead(seq, k).over(w).alias(f"_{k}") for k in (1, 2, 3)])
    at = lambda gap: F.max(F.struct(ts, seq, "_1")).over(Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, gap))
    rows = rows.withColumns({"_m": at(MONTH), "_h": at(HALF_YEAR), "after_seq": F.col("_1")}).where("_own")
    none = lambda s: F.col(f"{s}.{seq}") == F.col(seq)
    rows = rows.withColumn("after_1mo_seq", F.when(F.col("_1").isNotNull(), F.when(none("_m"), F.col("_2")).otherwise(F.col("_m._1"))))
    rows = rows.withColumn("after_6mo_seq", F.when(F.col("after_1mo_seq").isNotNull(), F.when(none("_h"), F.col("_3")).otherwise(F.col("_h._1"))))
    return rows.select(path, ts, seq, "after_seq", "after_1mo_seq", "after_6mo_seq")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slot, roots before commits, commits by time. Of each commit the set of roots above it is kept, as bits.

    A commit whose parents come later waits for them, so any order is right. What is held for a commit that adds no root
    to what its parent has is a reference.
    """
    out: list[tuple] = []
    slot, roots, bit_of, in_path, masks, waiting, absent = None, [], {}, {}, {}, {}, {}

    def emit() -> Iterator[pa.RecordBatch]:
        if out:
            cols = list(zip(*out))
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["repo", "root", "path", "hash", "ts", "seq"])

    def settle(row: tuple) -> None:
        todo = [row]
        while todo:
            repo, name, paths, ts, seq, parents = todo.pop()
            mask = 0
            for p in parents:
                above = masks.get(p, 0)
                mask = above if not mask else mask if above == mask else mask | above
            for path in paths if mask else ():
                left = mask & in_path.get(path, 0)
                while left:
                    low = left & -left
                    out.append((repo, roots[low.bit_length() - 1], path, name, ts, seq))
                    left ^= low
            own = bit_of.get(name, 0)
            masks[name] = mask | own if own else mask
            for other in waiting.pop(name, ()):
                absent[other[1]].discard(name)
                if not absent[other[1]]:
                    del absent[other[1]]
                    todo.append(other)

    def rest() -> None:
        """Commits that wait for what isn't there: such parents have no root above them."""
        while waiting:
            for p in [p for p in waiting if p not in absent] or list(waiting)[:1]:
                settle(("", p, (), None, None, ()))

    for batch in batches:
        for at, kind, repo, name, paths, ts, seq, parents in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if at != slot:
                rest()
                slot, roots, bit_of, in_path, masks, waiting, absent = at, [], {}, {}, {}, {}, {}
            if not kind:
                bit = 1 << len(roots)
                roots.append(name)
                bit_of[name] = bit_of.get(name, 0) | bit
                for p in paths:
                    in_path[p] = in_path.get(p, 0) | bit
                continue
            row = (repo, name, paths, ts, seq, parents)
            missing = {p for p in parents if p not in masks}
            if missing:
                absent[name] = missing
                for p in missing:
                    waiting.setdefault(p, []).append(row)
            else:
                settle(row)
            if len(out) > 20_000:
                yield from emit()
    rest()
    yield from emit()


class _Root:
    """A commit of which later versions of a path are looked for."""

    __slots__ = ("name", "path", "at", "bit", "old", "best", "open")

    def __init__(self, name: str, path: str, at: int | None, bit: int, gaps: int):
        self.name, self.path, self.at, self.bit = name, path, at, bit
        self.old: list[tuple] = []  # the keys of its oldest versions
        self.best: list[tuple | None] = [None] * gaps  # of each gap: the key of its newest version within it
        self.open = gaps


class _Path:
    """Sets of a path's roots, as bits: all, those that lack oldest versions, and for each gap those that it isn't over for."""

    def __init__(self, gaps: int):
        self.all = self.few = 0
        self.open = [0] * gaps
        #: For each gap: [key, roots], the version that is the newest one so far of which roots.
        self.groups: list[list[list]] = [[] for _ in range(gaps)]

    def sets(self, change) -> None:
        self.all, self.few, self.open = change(self.all), change(self.few), [change(x) for x in self.open]
        self.groups = [[[k, b] for k, x in g if (b := change(x))] for g in self.groups]


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


class _Line:
    """One repo's commits in order of time. Of a commit that still has children to come the set of roots above it is kept, as bits.

    A root is let go as soon as nothing can be found for it any more, and bits are numbered anew when most are free, so sets
    are as long as the roots that are looked for at a time. A commit whose parents come later waits for them.
    """

    def __init__(self, repo: str, few: int, gaps: tuple[int, ...], done):
        self.repo, self.few, self.gaps, self.done = repo, few, gaps, done
        self.roots: dict[int, _Root] = {}
        self.paths: dict[str, _Path] = {}
        self.masks: dict[str, list] = {}  # name: [set, children to come]
        self.waiting: dict[str, list[tuple]] = {}
        self.absent: dict[str, set[str]] = {}
        self.ends: list[list[tuple]] = [[] for _ in gaps]
        self.bit = self.count = self.since = 0
        self.last: tuple = ()
        self.todo: list[tuple] = []

    def add(self, row: tuple) -> None:
        missing = {p for p in row[4] if p not in self.masks}
        if missing:
            self.absent[row[0]] = missing
            for p in missing:
                self.waiting.setdefault(p, []).append(row)
        else:
            self.settle(row)

    def settle(self, row: tuple) -> None:
        todo = self.todo
        todo.append(row)
        while todo:
            name, ts, seq, paths, parents, children, wanted = todo.pop()
            mask = 0
            for p in parents:
                held = self.masks[p]
                mask = held[0] if not mask else mask if held[0] == mask else mask | held[0]
                held[1] -= 1
                if not held[1]:
                    del self.masks[p]
            key = (ts is not None, ts or 0, seq is not None, seq or 0, name)
            late = key < self.last
            if not late:
                self.last = key
                self.over(ts)
            for path in paths if mask else ():
                if (x := self.paths.get(path)) and mask & x.all:
                    (self.behind if late else self.found)(x, mask, key, ts)
            for path in wanted:
                mask |= 1 << self.start(name, path, ts)
            if children:
                self.masks[name] = [mask, children]
            for other in self.waiting.pop(name, ()):
                self.absent[other[0]].discard(name)
                if not self.absent[other[0]]:
                    del self.absent[other[0]]
                    todo.append(other)
            self.since += 1
        if self.since > max(TIDY, len(self.masks), len(self.roots)):
            self.tidy()

    def start(self, name: str, path: str, ts: int | None) -> int:
        root = self.roots[self.bit] = _Root(name, path, ts, self.bit, len(self.gaps))
        x, own = self.paths.setdefault(path, _Path(len(self.gaps))), 1 << self.bit
        x.all, x.few = x.all | own, x.few | own
        for g, gap in enumerate(self.gaps):
            x.open[g] |= own
            if ts is None:
                self.close(g, root)
            else:
                self.count += 1
                heapq.heappush(self.ends[g], (ts + gap, self.count, root))
        self.bit += 1
        return self.bit - 1

    def found(self, x: _Path, mask: int, key: tuple, ts: int | None) -> None:
        for b in _bits(mask & x.few):
            self.older(x, self.roots[b], key)
        for g in range(len(self.gaps)):
            own = mask & x.open[g] if ts is not None else 0
            if own:
                kept = [[k, left] for k, held in x.groups[g] if (left := held & ~own)]
                x.groups[g] = [*kept, [key, own]]

    def behind(self, x: _Path, mask: int, key: tuple, ts: int | None) -> None:
        """A commit that had to wait: it may be older than what was found since."""
        for b in list(_bits(mask & x.all)):
            root = self.roots[b]
            for g, gap in enumerate(self.gaps):
                if ts is None or root.at is None or ts > root.at + gap:
                    continue
                group = next((y for y in x.groups[g] if y[1] >> b & 1), None)
                best = group[0] if group else root.best[g]
                if best is None or key > best:
                    if x.open[g] >> b & 1:
                        if group:
                            group[1] ^= 1 << b
                        x.groups[g] = [*[y for y in x.groups[g] if y[1]], [key, 1 << b]]
                    else:
                        root.best[g] = key
            self.older(x, root, key)

    def older(self, x: _Path, root: _Root, key: tuple) -> None:
        root.old = sorted([*root.old, key])[: self.few]
        if len(root.old) == self.few:
            x.few &= ~(1 << root.bit)
            self.leave(root)

    def over(self, ts: int | None) -> None:
        for g, ends in enumerate(self.ends):
            while ends and ts is not None and ends[0][0] < ts:
                root = heapq.heappop(ends)[2]
                if self.roots.get(root.bit) is root:
                    self.close(g, root)

    def close(self, g: int, root: _Root) -> None:
        x = self.paths[root.path]
        x.open[g] &= ~(1 << root.bit)
        for i, y in enumerate(x.groups[g]):
            if y[1] >> root.bit & 1:
                root.best[g] = y[0]
                y[1] ^= 1 << root.bit
                if not y[1]:
                    del x.groups[g][i]
                break
        root.open -= 1
        self.leave(root)

    def leave(self, root: _Root, sure: bool = False) -> None:
        """Let a root go, if later commits can't change what was found; with ``sure`` there are none below it."""
        if sure or (not root.open and len(root.old) == self.few and not self.absent and not self.todo):
            x, b = self.paths[root.path], root.bit
            for g in range(len(self.gaps)):
                for y in x.groups[g]:
                    if y[1] >> b & 1:
                        root.best[g] = y[0]
            self.done((self.repo, root.path, root.name, [k[-1] for k in root.old], *[k and k[-1] for k in root.best]))
            del self.roots[b]
            x.all &= ~(1 << b)

    def tidy(self) -> None:
        self.since = 0
        above = 0
        # what waits is below parents that are held, or that wait themselves
        for m, _ in self.masks.values():
            above |= m
        on = np.unpackbits(np.frombuffer(above.to_bytes(self.bit // 8 + 1, "little"), np.uint8), bitorder="little")
        for b, root in list(self.roots.items()):
            self.leave(root, not on[b])
        if len(self.roots) > self.bit // 2:
            return
        kept = np.array(sorted(self.roots), np.int64)
        size = self.bit // 8 + 1
        known: dict[int, int] = {}

        def renumbered(x: int) -> int:
            if x not in known:
                on = np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")
                known[x] = int.from_bytes(np.packbits(on[kept], bitorder="little").tobytes(), "little")
            return known[x]

        for held in self.masks.values():
            held[0] = renumbered(held[0])
        for path, x in list(self.paths.items()):
            if x.all:
                x.sets(renumbered)
            else:
                del self.paths[path]
        self.roots = {i: self.roots[b] for i, b in enumerate(kept.tolist())}
        for i, root in self.roots.items():
            root.bit = i
        self.bit = len(kept)

    def end(self) -> None:
        while self.waiting:  # only where commits are among their own ancestors
            p = next(iter(self.waiting))
            rows = self.waiting.pop(p)
            self.masks.setdefault(p, [0, len(rows) + 1])
            for row in rows:
                self.absent[row[0]].discard(p)
                if not self.absent[row[0]]:
                    del self.absent[row[0]]
                    self.settle(row)
        for root in list(self.roots.values()):
            self.leave(root, True)


def _later(few: int, gaps: tuple[int, ...]):
    """Rows come sorted by repo and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        line = None
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * len(gaps)]
        names = ["repo", "path", "hash", "old", *[f"g{i}" for i in range(len(gaps))]]

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            for repo, *row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if line is None or repo != line.repo:
                    if line is not None:
                        line.end()
                    line = _Line(repo, few, gaps, out.append)
                line.add(tuple(row))
                if len(out) > 20_000:
                    yield emit()
        if line is not None:
            line.end()
        if out:
            yield emit()

    return run


def _once(commits: DataFrame) -> DataFrame:
    """Each commit once: repo, hash, ts, seq, parents, paths."""
    own = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return commits.where("repo is not null and hash is not null").groupBy("repo", "hash").agg(F.min("ts").cast("long").alias("ts"), F.min("seq").cast("long").alias("seq"), F.min(own("parents")).alias("parents"), F.array_distinct(F.flatten(F.collect_list(own("paths")))).alias("paths"))


def _linked(commits: DataFrame) -> DataFrame:
    """Each commit once, with those of its parents that are there, and how many are its children."""
    rows = _once(commits)
    up = rows.select("repo", F.col("hash").alias("child"), F.explode(F.array_distinct("parents")).alias("hash")).where("child <> hash").join(rows.select("repo", "hash"), ["repo", "hash"], "left_semi")
    parents = up.groupBy("repo", F.col("child").alias("hash")).agg(F.collect_list("hash").alias("parents"))
    children = up.groupBy("repo", "hash").agg(F.count("*").alias("children"))
    none = F.array().cast("array<string>")
    return rows.drop("parents").join(parents, ["repo", "hash"], "left").join(children, ["repo", "hash"], "left").select("repo", "hash", "ts", "seq", "paths", F.coalesce("parents", none).alias("parents"), F.coalesce("children", F.lit(0)).alias("children"))


def _nearest(linked: DataFrame, roots: DataFrame, few: int, gaps: tuple[int, ...]) -> DataFrame:
    """(repo, path, hash, old, g0, ..) for each root (repo, path, hash) that is a commit: of the versions of its path below it the
    ``few`` oldest, and for each gap the newest within so many seconds. A repo's commits pass through one task, once."""
    wanted = roots.select("repo", "hash", "path").dropna().groupBy("repo", "hash").agg(F.collect_set("path").alias("wanted"))
    rows = linked.join(wanted, ["repo", "hash"], "left").select("repo", "hash", "ts", "seq", "paths", "parents", "children", F.coalesce("wanted", F.array().cast("array<string>")).alias("wanted"))
    there = rows.repartition("repo").sortWithinPartitions("repo", "ts", "seq", "hash")
    return there.transform(arrow, _later(few, gaps), ", ".join(["repo string, path string, hash string, old array<string>", *[f"g{i} string" for i in range(len(gaps))]]))


def following(commits: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, root, path, hash, ts, seq): commits of a root's path among the root's descendants.

    ``commits``: repo, hash, ts, seq, parents (array), paths (array); ``roots``: repo, hash, path. Ids are strings. A repo's commits
    pass through a task as a stream, once for every ROOTS of its roots; merges, chains of any length and parents that
    aren't there are no special cases. Rows with a null repo or hash are left out, repeated ones count once.
    """
    wanted = roots.select("repo", "hash", "path").dropna().distinct()
    blocks = wanted.groupBy("repo").agg(F.ceil(F.count("*") / ROOTS).cast("int").alias("n"))
    first = wanted.join(blocks, "repo").select(F.struct("repo", F.pmod(F.xxhash64("hash", "path"), "n").cast("int").alias("block")).alias("slot"), F.lit(False).alias("kind"), "repo", "hash", F.array("path").alias("paths"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("long").alias("seq"), F.array().cast("array<string>").alias("parents"))
    rows = _once(commits)
    rows = rows.join(blocks, "repo").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    rows = rows.select(F.struct("repo", "block").alias("slot"), F.lit(True).alias("kind"), "repo", "hash", "paths", F.col("ts").cast("long"), F.col("seq").cast("long"), "parents")
    both = first.unionByName(rows).repartition("slot").sortWithinPartitions("slot", "kind", "ts", "seq")
    return both.transform(arrow, _followed, "repo string, root string, path string, hash string, ts long, seq long")


def descendants(commits: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, root, hash) of all commits reachable from each root over parent links. ``commits``: repo, hash, ts, seq, parents; ``roots``: repo, hash."""
    every = F.array(F.lit("")).cast("array<string>")
    return following(commits.withColumn("paths", every), roots.select("repo", "hash", F.lit("").alias("path"))).select("repo", "root", "hash")


def versions_along(commits: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, path, hash, after, after_1mo, after_6mo) for each root: later versions of its path along the ancestry, so only among its descendants.

    ``after`` is the oldest. The one after a month is the oldest descendant of the newest version within 30 days, or, where none is
    within them, the oldest not taken yet; the same for 180 days. Each is looked for only if the one before was found, and
    the one after half a year may be that after a month. Input as for :func:`following`; no row is made for a pair of a root and a later version.
    """
    linked = cut(_linked(commits), "history")
    # the three oldest are all that can be taken where nothing is within the time
    near = cut(_nearest(linked, roots, 3, (MONTH, HALF_YEAR)).withColumnsRenamed({"g0": "m", "g1": "h"}), "later")
    turns = near.select("repo", "path", F.explode(F.array("m", "h")).alias("hash")).dropna()
    after = _nearest(linked, turns, 1, ()).select("repo", F.col("hash").alias("turn"), "path", F.try_element_at("old", F.lit(1)).alias("next"))
    rows = roots.select("repo", "path", "hash").dropna().distinct().join(near, ["repo", "path", "hash"], "left")
    for c in ("m", "h"):
        rows = rows.join(after.select("repo", "path", F.col("turn").alias(c), F.col("next").alias(f"{c}_next")), ["repo", "path", c], "left")
    names = F.coalesce("old", F.array().cast("array<string>"))
    first = lambda *taken: F.try_element_at(F.filter(names, lambda x: ~F.coalesce(F.array_contains(F.array(*taken), x), F.lit(False))), F.lit(1))
    rows = rows.withColumn("after", F.try_element_at(names, F.lit(1)))
    rows = rows.withColumn("after_1mo", F.when(F.col("after").isNotNull(), F.when(F.col("m").isNull(), first("after")).otherwise(F.col("m_next"))))
    rows = rows.withColumn("after_6mo", F.when(F.col("after_1mo").isNotNull(), F.when(F.col("h").isNull(), first("after", "after_1mo")).otherwise(F.col("h_next"))))
    return rows.select("repo", "path", "hash", "after", "after_1mo", "after_6mo")
