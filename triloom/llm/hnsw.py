"""A hierarchical navigable small-world graph in flat arrays, built and searched in lockstep over many vectors.

Every level is one array of neighbours, a row for each of its nodes, -1 where a row is not full. A search keeps a beam for
each query; each round expands the nearest open nodes of all queries at once, so the work is a few large numpy calls
instead of many small ones. Nodes are inserted in batches no larger than the graph they are inserted into, with the
neighbours picked for diversity as usual.
"""

from __future__ import annotations

import numpy as np


class Hnsw:
    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 80, seed: int = 1):
        """``x``: (n, d); ``m``: neighbours on upper levels, twice that on the ground; ``ef``: beam while building."""
        self.x = np.ascontiguousarray(x, np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        u = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 6)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # nodes, place of a node, neighbours
        order = np.argsort(-level, kind="stable")
        for at in range(int(level.max()) if n else 0, -1, -1):
            nodes = order[: int((level >= at).sum())]
            place = np.full(n, -1, np.int32)
            place[nodes] = np.arange(len(nodes), dtype=np.int32)
            width = 2 * m if at == 0 else m
            self.levels.append((nodes, place, np.full((len(nodes), width), -1, np.int32)))
            self._fill(len(self.levels) - 1, m, ef)

    def _fill(self, at: int, m: int, ef: int) -> None:
        nodes, _, links = self.levels[at]
        width = links.shape[1]
        done = min(len(nodes), 256)
        if done > 1:
            first = nodes[:done]
            d = self._cross(first, first)
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, axis=1, kind="stable")[:, : min(done - 1, ef)]
            self._link(at, np.arange(done), first[near], np.take_along_axis(d, near, 1), m)
        while done < len(nodes):
            more = nodes[done : min(len(nodes), 2 * done)]
            ids, d = self._search(self.x[more], self.sq[more], ef, at, done)
            # the batch itself: those close to each other shall be linked too
            for lo in range(0, len(more), 1024):
                part = more[lo : lo + 1024]
                own = self._cross(part, part)
                np.fill_diagonal(own, np.inf)
                k = min(width, len(part) - 1)
                if k > 0:
                    pick = np.argpartition(own, k - 1, axis=1)[:, :k]
                    got = np.c_[ids[lo : lo + 1024], part[pick]]
                    gap = np.c_[d[lo : lo + 1024], np.take_along_axis(own, pick, 1)]
                else:
                    got, gap = ids[lo : lo + 1024], d[lo : lo + 1024]
                best = np.argsort(gap, axis=1, kind="stable")[:, :ef]
                self._link(at, np.arange(done + lo, done + lo + len(part)), np.take_along_axis(got, best, 1), np.take_along_axis(gap, best, 1), m)
            done += len(more)

    def _cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(self.sq[a][:, None] + self.sq[b][None] - 2 * self.x[a] @ self.x[b].T, 0)

    def _diverse(self, ids: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
        """Of the candidates, sorted by distance, up to m that are nearer to the node than to any picked before; then the nearest others."""
        q, c = ids.shape
        pick = np.zeros((q, c), bool)
        count = np.zeros(q, int)
        v = self.x[np.maximum(ids, 0)]
        sq = self.sq[np.maximum(ids, 0)]
        mutual = np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1), 0)
        valid = (ids >= 0) & np.isfinite(d)
        for j in range(c):
            clear = ~(pick[:, :j] & (mutual[:, j, :j] < d[:, j : j + 1])).any(axis=1) if j else np.ones(q, bool)
            take = clear & (count < m) & valid[:, j]
            pick[:, j] = take
            count += take
        rank = np.where(pick, 0, np.where(valid, 1, 2)) * c + np.arange(c)
        best = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(ids, best, 1), -1)

    def _link(self, at: int, rows: np.ndarray, ids: np.ndarray, d: np.ndarray, m: int) -> None:
        nodes, place, links = self.levels[at]
        width = links.shape[1]
        for lo in range(0, len(rows), 256):
            r = rows[lo : lo + 256]
            best = self._diverse(ids[lo : lo + 256], d[lo : lo + 256], m)
            links[r, : best.shape[1]] = best
        # the way back
        new = links[rows][:, :m]
        src = np.repeat(nodes[rows], new.shape[1])
        dst = new.ravel()
        ok = dst >= 0
        src, dst = src[ok], place[dst[ok]]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, start, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(targets), 256):
            t, s, c = (v[lo : lo + 256] for v in (targets, start, count))
            wide = int(c.max())
            add = np.full((len(t), wide), -1, np.int64)
            col = np.arange(wide)[None] < c[:, None]
            add[col] = np.concatenate([src[a : a + b] for a, b in zip(s, c)])
            both = np.c_[links[t], add]
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both[both == nodes[t][:, None]] = -1
            dist = np.where(both >= 0, self.sq[np.maximum(both, 0)] + self.sq[nodes[t]][:, None] - 2 * np.einsum("qcd,qd->qc", self.x[np.maximum(both, 0)], self.x[nodes[t]]), np.inf)
            if (np.isfinite(dist).sum(axis=1) <= width).all():
                best = np.argsort(dist, axis=1, kind="stable")[:, :width]
                links[t, : best.shape[1]] = np.where(np.isfinite(np.take_along_axis(dist, best, 1)), np.take_along_axis(both, best, 1), -1)
            else:
                best = np.argsort(dist, axis=1, kind="stable")[:, : 2 * width]
                kept = self._diverse(np.take_along_axis(both, best, 1), np.take_along_axis(dist, best, 1), width)
                links[t] = -1
                links[t, : kept.shape[1]] = kept

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and squared distances of about the k nearest vectors of each query, nearest first; -1 and inf where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        ids = np.full((len(q), k), -1, np.int64)
        d = np.full((len(q), k), np.inf, np.float32)
        if len(self.x):
            step = max(16, min(1024, (64 << 20) // max(1, len(self.x))))
            for lo in range(0, len(q), step):
                part = q[lo : lo + step]
                i, g = self._search(part, np.einsum("ij,ij->i", part, part), max(ef, k), len(self.levels) - 1, len(self.levels[-1][0]))
                ids[lo : lo + step, : min(k, i.shape[1])] = i[:, :k]
                d[lo : lo + step, : min(k, i.shape[1])] = g[:, :k]
        return ids, d

    def _search(self, q: np.ndarray, sq: np.ndarray, ef: int, ground: int, filled: int) -> tuple[np.ndarray, np.ndarray]:
        """Search from the top down to level ``ground``, of which ``filled`` nodes are linked."""
        out_i, out_d = [], []
        step = max(16, min(1024, (64 << 20) // max(1, len(self.x))))
        for lo in range(0, len(q), step):
            p, s = q[lo : lo + step], sq[lo : lo + step]
            top = self.levels[0][0][:1] if ground or filled else self.levels[0][0][:1]
            ids = np.repeat(top[None], len(p), 0)
            d = self._far(p, s, np.arange(len(p)), ids[:, 0])[:, None]
            for at in range(ground + 1):
                ids, d = self._beam(p, s, ids, d, ef if at == ground else 4, at)
            out_i.append(ids)
            out_d.append(d)
        return np.concatenate(out_i), np.concatenate(out_d)

    def _far(self, q: np.ndarray, sq: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.maximum(self.sq[node] + sq[row] - 2 * np.einsum("ij,ij->i", self.x[node], q[row]), 0)

    def _beam(self, q, sq, ids, d, ef: int, at: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
        _, place, links = self.levels[at]
        n = len(q)
        beam = np.full((n, ef), -1, np.int64)
        dist = np.full((n, ef), np.inf, np.float32)
        k = min(ef, ids.shape[1])
        beam[:, :k], dist[:, :k] = ids[:, :k], d[:, :k]
        open_ = beam >= 0
        seen = np.zeros((n, len(self.x)), bool)
        r, c = np.nonzero(beam >= 0)
        seen[r, beam[r, c]] = True
        live = np.arange(n)
        while len(live):
            cost = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(cost, min(width, ef) - 1, axis=1)[:, :width] if ef > width else np.tile(np.arange(ef), (len(live), 1))
            use = np.isfinite(np.take_along_axis(cost, pick, 1))
            row = np.repeat(live, use.sum(axis=1))
            node = beam[live[:, None], pick][use]
            open_[np.repeat(live, use.sum(axis=1)), pick[use]] = False
            nb = links[place[node]]
            rr = np.repeat(row, nb.shape[1])
            nn = nb.ravel()
            ok = nn >= 0
            rr, nn = rr[ok], nn[ok]
            new = ~seen[rr, nn]
            rr, nn = rr[new], nn[new]
            if len(rr):
                key = np.unique(rr * len(self.x) + nn)
                rr, nn = key // len(self.x), key % len(self.x)
                seen[rr, nn] = True
                gap = self._far(q, sq, rr, nn)
                better = gap < dist[rr, -1]
                rr, nn, gap = rr[better], nn[better], gap[better]
            if len(rr):
                rows, first, count = np.unique(rr, return_index=True, return_counts=True)
                wide = int(count.max())
                at_col = np.arange(len(rr)) - np.repeat(first, count)
                add_i = np.full((len(rows), wide), -1, np.int64)
                add_d = np.full((len(rows), wide), np.inf, np.float32)
                where = np.repeat(np.arange(len(rows)), count)
                add_i[where, at_col], add_d[where, at_col] = nn, gap
                all_d = np.c_[dist[rows], add_d]
                best = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
                dist[rows] = np.take_along_axis(all_d, best, 1)
                beam[rows] = np.take_along_axis(np.c_[beam[rows], add_i], best, 1)
                open_[rows] = np.take_along_axis(np.c_[open_[rows], add_i >= 0], best, 1)
            live = live[open_[live].any(axis=1)]
        return beam, dist
