"""Graph matchers: algorithms that grow a mapping step by step, run on one pair of graphs at a time.

A graph is one row with arrays of its nodes and edges; pairs are joined to both of their graphs and matched in Arrow
batches, so pairs, not graphs, are what is distributed. Ties are settled by score, then by the smaller node.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.session import arrow


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn_id, nodes, edges): one row for each graph. A graph is matched in one task, so it must fit there."""
    n = nodes.groupBy("fn_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "type", "code"))).alias("nodes"))
    e = edges.groupBy("fn_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "rel"))).alias("edges"))
    return n.join(e, "fn_id", "left")


class Graph:
    """A simple digraph; of parallel edges the smallest relation stays."""

    def __init__(self, nodes: list[dict], edges: list[dict] | None):
        self.label = {n["node_id"]: n["type"] for n in nodes}
        self.code = {n["node_id"]: n.get("code") for n in nodes}
        self.rel: dict[tuple[str, str], str] = {}
        for e in sorted(edges or [], key=lambda e: (e["src"], e["dst"], e["rel"])):
            if e["src"] in self.label and e["dst"] in self.label:
                self.rel.setdefault((e["src"], e["dst"]), e["rel"])
        self.out: dict[str, set[str]] = {n: set() for n in self.label}
        self.inn: dict[str, set[str]] = {n: set() for n in self.label}
        for a, b in self.rel:
            self.out[a].add(b)
            self.inn[b].add(a)

    def degree(self, n: str) -> int:
        return len(self.out[n]) + len(self.inn[n])

    def near(self, n: str) -> set[str]:
        return self.out[n] | self.inn[n]

    def top(self, share: float) -> list[str]:
        """The nodes of highest degree, at least one; of equals the larger id."""
        return sorted(self.label, key=lambda n: (self.degree(n), n), reverse=True)[: max(1, int(len(self.label) * share))]


def assignment(weights: dict[tuple[str, str], float]) -> dict[str, str]:
    """A one-to-one assignment of the largest total weight; pairs that aren't named are not assigned. Shortest augmenting paths."""
    rows, cols = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    n, m = len(rows), len(cols) + len(rows)  # a place of its own for each row that stays free
    inf = float("inf")
    cost = [[-weights.get((r, c), 0.0) if (r, c) in weights else 0.0 for c in cols] + [0.0] * n for r in rows]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, done = [inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, m + 1):
                if not done[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return {rows[owner[j] - 1]: cols[j - 1] for j in range(1, len(cols) + 1) if owner[j] and (rows[owner[j] - 1], cols[j - 1]) in weights}


Match = tuple[dict[str, tuple[str, float]], float]


def exact_match(q: Graph, t: Graph) -> Match:
    """100 if ``q`` is an induced subgraph of ``t`` with equal types and relations, else 0. The mapping is empty."""
    order: list[str] = []
    left = set(q.label)
    while left:  # nodes that touch those before come first, so that candidates are few
        touching = [n for n in left if any(x in q.near(n) for x in order)]
        n = max(touching or left, key=lambda x: (q.degree(x), x))
        order.append(n)
        left.discard(n)
    by_label: dict[str, list[str]] = {}
    for n, x in sorted(t.label.items()):
        by_label.setdefault(x, []).append(n)
    image: dict[str, str] = {}
    stack = [iter(by_label.get(q.label[order[0]], ()))] if order else []
    while stack:
        n = order[len(stack) - 1]
        image.pop(n, None)
        used = set(image.values())
        for c in stack[-1]:
            if c not in used and q.rel.get((n, n)) == t.rel.get((c, c)) and all(q.rel.get((n, x)) == t.rel.get((c, y)) and q.rel.get((x, n)) == t.rel.get((y, c)) for x, y in image.items()):
                image[n] = c
                break
        else:
            stack.pop()
            continue
        if len(stack) == len(order):
            return {}, 100.0
        nxt = order[len(stack)]
        stack.append(iter(by_label.get(q.label[nxt], ())))
    return {}, 0.0 if order else 100.0


def tolerant_match(q: Graph, t: Graph, share: float = 0.2, miss_share: float = 0.1) -> Match:
    """Neighbourhood matching with tolerance: assign the important nodes, then grow over neighbours one and two steps away.

    The score is the sum of node scores over twice the number of query nodes.
    """

    def index(g: Graph) -> dict[str, tuple]:
        return {n: (g.label[n], g.degree(n), {g.label[x] for x in g.out[n]}, sum(len(g.out[x] & g.out[n]) for x in g.out[n]) // 2) for n in g.label}

    qi, ti = index(q), index(t)

    def score(a: str, b: str) -> float:
        (l, d, nb, links), (tl, td, tnb, tlinks) = qi[a], ti[b]
        may = int(miss_share * d)
        miss = len(nb - tnb)
        if l != tl or td < d - may or miss > may or tlinks < links - (may * ((may - 1) // 2) + (d - may) * may):
            return 0.0
        f_links = max(0, links - tlinks) / links if links else 0.0
        return 2.0 - f_links if not miss else 2.0 - (miss / d + f_links / miss)

    weights = {(a, b): s for a in q.top(share) for b in t.label if (s := score(a, b)) > 0}
    found = {a: (b, weights[a, b]) for a, b in assignment(weights).items()} if weights else {}
    queue = deque(sorted(found, key=lambda a: (found[a][1], a), reverse=True))
    done: dict[str, tuple[str, float]] = {}

    def grow(sources: set[str], free: set[str]) -> None:
        for a in sorted(sources):
            best = min(((-w, b) for b in free if (w := score(a, b)) > 0), default=None)
            if best is None:
                continue
            if a not in queue:
                queue.append(a)
            elif -best[0] <= found[a][1]:
                continue
            found[a] = (best[1], -best[0])
            free.discard(best[1])

    while queue:
        a = queue.popleft()
        b = found[a][0]
        done[a] = found[a]
        taken = {x for x, _ in done.values()} | {found[x][0] for x in queue}
        one_q = q.out[a] - done.keys()
        two_q = set().union(*(q.out[x] for x in q.out[a])) - one_q - done.keys()
        one_t = t.out[b] - taken
        two_t = set().union(*(t.out[x] for x in t.out[b])) - one_t - taken
        grow(one_q, one_t)
        grow(one_q, two_t - {found[x][0] for x in queue})
        grow(two_q, one_t - {found[x][0] for x in queue})
    return done, sum(s for _, s in done.values()) / (2.0 * len(q.label)) if q.label else 0.0


def path_match(q: Graph, t: Graph, share: float = 0.1) -> Match:
    """Growth along a breadth-first tree from the best important node, trying each feasible neighbour on a copy of the mapping.

    A node scores 1 if the target covers it (label, degrees, neighbour labels and relations in both directions), else 0. The
    score is the grown path's total over the number of query nodes. Trials that can't be better, or were made before, are left out.
    """

    def index(g: Graph) -> dict[str, tuple]:
        return {n: (g.label[n], len(g.inn[n]), len(g.out[n]), {g.label[x] for x in g.inn[n]}, {g.label[x] for x in g.out[n]}, {g.rel[x, n] for x in g.inn[n]}, {g.rel[n, x] for x in g.out[n]}) for n in g.label}

    qi, ti = index(q), index(t)
    memo: dict[tuple[str, str], bool] = {}

    def fits(a: str, b: str) -> bool:
        if (a, b) not in memo:
            x, y = qi[a], ti[b]
            memo[a, b] = x[0] == y[0] and x[1] <= y[1] and x[2] <= y[2] and all(i <= j for i, j in zip(x[3:], y[3:]))
        return memo[a, b]

    seeds = []
    for a in q.top(share) if q.label else ():
        for b in t.label:
            if fits(a, b):
                near = {(x, y): 1.0 for x in q.near(a) for y in t.near(b) if fits(x, y)}
                seeds.append((-1.0 - len(assignment(near)), a, b))
    if not seeds:
        return {}, 0.0
    _, root, goal = min(seeds)
    children: dict[str, list[str]] = {}
    seen, todo = {root}, deque([root])
    order = []
    while todo:
        n = todo.popleft()
        order.append(n)
        children[n] = sorted(q.near(n) - seen)
        seen.update(children[n])
        todo.extend(children[n])
    height = {}
    for n in reversed(order):
        height[n] = 1 + sum(height[c] for c in children[n])
    ways: dict[tuple[str, str], dict[str, list[str]]] = {}
    reach: dict[tuple[str, str], tuple[int, frozenset[str]]] = {}

    def options(a: str, b: str) -> dict[str, list[str]]:
        if (a, b) not in ways:
            near = {n: (t.out[b] if n in q.out[a] else set()) | (t.inn[b] if n in q.inn[a] else set()) for n in sorted(children[a], key=lambda x: (-height[x], x))}
            ways[a, b] = {n: good for n, ys in near.items() if (good := sorted(y for y in ys if fits(n, y)))}
        return ways[a, b]

    def most(a: str, b: str) -> tuple[int, frozenset[str]]:
        """The score of growth from (a, b) if no target node were taken, and the target nodes it could come to."""
        if (a, b) not in reach:
            below = [[(y, *most(n, y)) for y in ys] for n, ys in options(a, b).items()]
            reach[a, b] = sum(1 + max(s for _, s, _ in x) for x in below), frozenset().union(*(r | {y} for x in below for y, _, r in x))
        return reach[a, b]

    grown: dict[tuple[str, str, frozenset[str]], tuple[float, dict[str, str]]] = {}

    def grow(a: str, b: str, taken: frozenset[str]) -> tuple[float, dict[str, str]]:
        """Depends on no more of ``taken`` than growth from (a, b) can come to."""
        key = a, b, taken & most(a, b)[1]
        if key in grown:
            return grown[key]
        total, added, used = 0.0, {}, key[2]
        for n, ys in options(a, b).items():
            best = None
            for y in ys:
                if y in used or best and most(n, y)[0] <= best[0]:  # only a better one counts
                    continue
                s, more = grow(n, y, used | {y})
                if best is None or s > best[0]:
                    best = (s, y, more)
            if best:
                added = {**added, **best[2], n: best[1]}
                used = used | {best[1], *best[2].values()}
                total += best[0] + 1.0
        grown[key] = total, added
        return grown[key]

    score, added = grow(root, goal, frozenset({goal}))
    mapping = {root: (goal, 1.0), **{n: (y, 1.0) for n, y in added.items()}}
    score += 1.0
    return mapping, score / len(q.label)


MATCHERS: dict[str, Callable[[Graph, Graph], Match]] = {"exact": exact_match, "tolerant": tolerant_match, "path": path_match}


class Matcher(Protocol):
    """What a matcher offers: both sides are prepared once, then pairs (q_fn, t_fn) are matched to (q_fn, t_fn, score, mapping)."""

    def prepare_query(self, nodes: DataFrame, edges: DataFrame) -> DataFrame: ...

    def prepare_target(self, nodes: DataFrame, edges: DataFrame) -> DataFrame: ...

    def match(self, pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class GraphMatcher:
    """A matcher by one of the algorithms in MATCHERS."""

    how: str

    def prepare_query(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return packed(nodes, edges)

    prepare_target = prepare_query

    def match(self, pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
        return match(pairs, queries, self.how, targets)


def match(pairs: DataFrame, graphs: DataFrame, how: str, targets: DataFrame | None = None) -> DataFrame:
    """(q_fn, t_fn, score, mapping) of every pair (q_fn, t_fn) by the matcher ``how``; graphs as :func:`packed` makes them, those of targets from ``targets`` if given."""
    side = lambda s, of: of.select(F.col("fn_id").alias(f"{s}_fn"), F.col("nodes").alias(f"{s}_nodes"), F.col("edges").alias(f"{s}_edges"))
    rows = pairs.select("q_fn", "t_fn").join(side("q", graphs), "q_fn").join(side("t", graphs if targets is None else targets), "t_fn").select("q_fn", "t_fn", "q_nodes", "q_edges", "t_nodes", "t_edges")
    algorithm = MATCHERS[how]

    def run(batches):
        import sys

        import pyarrow as pa

        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        kind = pa.map_(pa.string(), pa.struct([("t", pa.string()), ("score", pa.float64())]))
        for b in batches:
            out = [algorithm(Graph(qn, qe), Graph(tn, te)) for qn, qe, tn, te in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            maps = pa.array([sorted((k, {"t": t, "score": s}) for k, (t, s) in m.items()) for m, _ in out], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for _, s in out], pa.float64()), maps], ["q_fn", "t_fn", "score", "mapping"])

    return rows.transform(arrow, run, "q_fn string, t_fn string, score double, mapping map<string, struct<t: string, score: double>>")


def assigned(weights: DataFrame) -> DataFrame:
    """(q_fn, t_fn, a, b, w): for each pair of graphs the one-to-one assignment of the largest total weight. ``weights``: the same columns, w above 0; of equal (a, b) the largest counts."""
    rows = weights.groupBy("q_fn", "t_fn", "a", "b").agg(F.max("w").alias("w")).groupBy("q_fn", "t_fn").agg(F.sort_array(F.collect_list(F.struct("a", "b", "w"))).alias("held"))  # two graphs' nodes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for q, t, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                w = {(x["a"], x["b"]): x["w"] for x in held}
                out += [(q, t, a, b, w[a, b]) for a, b in sorted(assignment(w).items())]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [pa.string()] * 4 + [pa.float64()])], ["q_fn", "t_fn", "a", "b", "w"])

    return rows.transform(arrow, run, "q_fn string, t_fn string, a string, b string, w double")


def connected(sets: DataFrame, graphs: DataFrame) -> DataFrame:
    """(sig_id, side, fn_id, node_id): each set of nodes with those that :func:`connect` adds. ``sets``: the same columns."""
    held = sets.groupBy("sig_id", "side", "fn_id").agg(F.sort_array(F.collect_set("node_id")).alias("chosen"))  # one graph's nodes
    rows = held.join(graphs, "fn_id").select("sig_id", "side", "fn_id", "chosen", "nodes", "edges")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(*keys, n) for *keys, chosen, nodes, edges in zip(*(batch.column(i).to_pylist() for i in range(6))) for n in sorted(connect(set(chosen), Graph(nodes, edges)))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["sig_id", "side", "fn_id", "node_id"])

    return rows.transform(arrow, run, "sig_id string, side string, fn_id string, node_id string")


def connect(small: set[str], big: Graph) -> set[str]:
    """``small`` and the nodes of shortest paths of the undirected big graph that join its components, the two largest first.

    Components that no path joins stay apart.
    """
    chosen = set(small)
    while True:
        parts, left = [], set(chosen)
        while left:
            part, todo = set(), [min(left)]
            while todo:
                n = todo.pop()
                if n in part:
                    continue
                part.add(n)
                todo += big.near(n) & chosen - part
            parts.append(part)
            left -= part
        parts.sort(key=lambda p: (-len(p), min(p)))
        for i, a in enumerate(parts):
            for b in parts[i + 1 :]:
                if path := _shortest(a, b, big):
                    chosen |= set(path)
                    break
            else:
                continue
            break
        else:
            return chosen


def _shortest(a: set[str], b: set[str], g: Graph) -> list[str] | None:
    back: dict[str, str | None] = {n: None for n in sorted(a)}
    todo = deque(back)
    while todo:
        n = todo.popleft()
        if n in b:
            path = []
            while n is not None:
                path.append(n)
                n = back[n]
            return path
        for x in sorted(g.near(n)):
            if x not in back:
                back[x] = n
                todo.append(x)
    return None


def expand_to(small: set[str], big: Graph, least: int) -> set[str]:
    """``small`` grown one step at a time until it has ``least`` nodes or can't grow."""
    chosen = set(small)
    while chosen and len(chosen) < least:
        more = chosen | set().union(*(big.near(n) for n in chosen))
        if more == chosen:
            break
        chosen = more
    return chosen


def aligned_signature(sig: DataFrame, changed: DataFrame, mapping: DataFrame, graphs: DataFrame, least: int = 50) -> DataFrame:
    """(sig_id, positive, negative, context): node sets of the aligned signature, each connected and grown to ``least`` nodes.

    Positive are nodes only the vulnerable version has, negative those only the fixed one has, context the shared nodes next
    to either. An empty set stays empty.
    """
    own = lambda s: changed.where(F.col("side") == s).groupBy("sig_id").agg(F.collect_list("node_id").alias(f"{s}_only"))
    maps = mapping.groupBy("sig_id").agg(F.collect_list(F.struct("v_node", "p_node")).alias("pairs"))
    side = lambda s: graphs.select(F.col("fn_id").alias(f"{s}_id"), F.col("nodes").alias(f"{s}_nodes"), F.col("edges").alias(f"{s}_edges"))
    rows = sig.select("sig_id", "v_id", "p_id").join(side("v"), "v_id").join(side("p"), "p_id").join(own("v"), "sig_id", "left").join(own("p"), "sig_id", "left").join(maps, "sig_id", "left")
    rows = rows.select("sig_id", "v_nodes", "v_edges", "p_nodes", "p_edges", "v_only", "p_only", "pairs")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for vn, ve, pn, pe, vo, po, pairs in zip(*(b.column(i).to_pylist() for i in range(1, 8))):
                v, p = Graph(vn, ve), Graph(pn, pe)
                positive = expand_to(connect(set(vo or ()), v), v, least)
                negative = expand_to(connect(set(po or ()), p), p, least)
                context = {x["v_node"] for x in pairs or () if x["v_node"] not in positive and x["p_node"] not in negative and (v.near(x["v_node"]) & positive or p.near(x["p_node"]) & negative)}
                context = expand_to(connect(context, v), v, least)
                out.append(tuple(sorted(s) for s in (positive, negative, context)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), pa.list_(pa.string())) for c in cols]], ["sig_id", "positive", "negative", "context"])

    return rows.transform(arrow, run, "sig_id string, positive array<string>, negative array<string>, context array<string>")
