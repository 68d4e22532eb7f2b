"""Hierarchical navigable small-world graph over one shard of unit vectors, in numpy, for many points at once.

Nodes are kept in order of falling level, so that the graph of level l covers a prefix of the nodes. Each level is built
from the top: a batch of nodes searches the graph so far (entered through the level above) and its own batch, keeps
diverse neighbours, and is linked back. A search goes down the levels with a narrow beam and ends with a wide one.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(-1)
#: Nodes that a query expands in a step, at least.
EXPAND = 6


class Graph:
    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        """vectors: unit rows in node order. links: for each level from 0, the neighbours of its prefix of nodes."""
        self.v, self.links = np.ascontiguousarray(vectors, dtype=np.float32), links

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray, m: int = 16, beam: int = 48, batch: int = 512) -> tuple["Graph", np.ndarray]:
        """The graph and the order of its nodes. keys: well mixed 64-bit numbers, which decide the levels; reruns agree."""
        u = (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int)
        order = np.lexsort((keys, -level))
        graph = cls(vectors[order], [])
        level = level[order]
        graph.links = [np.full((int((level >= k).sum()), 2 * m if not k else m), NONE, dtype=np.int32) for k in range(level.max(initial=0) + 1)]
        for k in reversed(range(len(graph.links))):
            for at in range(0, len(graph.links[k]), batch):
                graph._insert(k, at, min(at + batch, len(graph.links[k])), m, beam)
        return graph, order

    def _insert(self, k: int, lo: int, hi: int, m: int, beam: int) -> None:
        links, new = self.links[k], self.v[lo:hi]
        peers = new @ new.T
        np.fill_diagonal(peers, -np.inf)
        near = np.argsort(-peers, axis=1, kind="stable")[:, : min(2 * m, hi - lo - 1)]
        found, sims = (near + lo).astype(np.int32), np.take_along_axis(peers, near, 1)
        if lo:
            ids, s = self._beam(k, new, self._down(new, k, lo), beam, lo)
            found, sims = np.hstack([ids, found]), np.hstack([s, sims])
        chosen = self._diverse(found, sims, m)
        links[lo:hi, :m] = chosen
        src = np.repeat(np.arange(lo, hi, dtype=np.int32), chosen.shape[1])
        self._link_back(k, chosen.ravel(), src)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row's candidates, first those nearer to the row than to one chosen before, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        real = (ids >= 0) & np.isfinite(sims)
        v = self.v[np.where(real, ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        closest = np.full(ids.shape, -np.inf, dtype=np.float32)
        taken, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=int)
        for j in range(ids.shape[1]):
            ok = real[:, j] & (count < m) & (closest[:, j] < sims[:, j])
            taken[:, j], count = ok, count + ok
            np.maximum(closest, np.where(ok[:, None], among[:, j, :], -np.inf), out=closest)
        rank = np.argsort(np.where(taken, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(ids, rank, 1), NONE)
        return np.hstack([out, np.full((len(out), m - out.shape[1]), NONE, dtype=np.int32)]) if out.shape[1] < m else out.astype(np.int32)

    def _link_back(self, k: int, target: np.ndarray, src: np.ndarray) -> None:
        links, keep = self.links[k], target >= 0
        target, src = target[keep], src[keep]
        sim = np.einsum("ij,ij->i", self.v[target], self.v[src])
        order = np.lexsort((src, -sim, target))
        target, src = target[order], src[order]
        nodes, start, many = np.unique(target, return_index=True, return_counts=True)
        if not len(nodes):
            return
        width = links.shape[1]
        slot = np.arange(len(target)) - np.repeat(start, many)
        fits = slot < width
        added = np.full((len(nodes), min(width, int(many.max()))), NONE, dtype=np.int32)
        added[np.repeat(np.arange(len(nodes)), many)[fits], slot[fits]] = src[fits]
        old = links[nodes]
        added[(added[:, :, None] == old[:, None, :]).any(2)] = NONE
        both = np.hstack([old, added])
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both >= 0).sum(1) > width
        out = both[:, :width].copy()
        for at in range(0, int(full.sum()), 1024):
            rows = np.flatnonzero(full)[at : at + 1024]
            ids = both[rows]
            sims = np.einsum("ijk,ik->ij", self.v[np.maximum(ids, 0)], self.v[nodes[rows]])
            out[rows] = self._diverse(ids, np.where(ids >= 0, sims, -np.inf), width)
        links[nodes] = out

    def _down(self, q: np.ndarray, k: int, upto: int) -> np.ndarray:
        """Entry nodes for level k: the best few that the levels above lead to."""
        top = len(self.links) - 1
        n = min(len(self.links[top]), upto)
        if k >= top:
            n = min(upto, 32)
        sims = q @ self.v[:n].T
        entry = np.argsort(-sims, axis=1, kind="stable")[:, :4].astype(np.int32)
        for level in range(top, k, -1):
            if len(self.links[level]) <= upto:
                entry = self._beam(level, q, entry, 12, len(self.links[level]))[0][:, :6]
        return entry

    def _beam(self, k: int, q: np.ndarray, entry: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes that each query reaches, with their similarity, in falling order; -1 where fewer.

        In each step a query looks at the neighbours of its best few nodes that are still open, more of them for wide beams.
        """
        expand = max(EXPAND, width // 8)
        links, rows = self.links[k], np.arange(len(q))
        width = max(1, min(width, n))
        expand = min(expand, width)
        seen = np.zeros((len(q), n), dtype=bool)
        ids = np.full((len(q), width), NONE, dtype=np.int32)
        sims = np.full((len(q), width), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), width), dtype=bool)

        def offer(rows: np.ndarray, nodes: np.ndarray) -> None:
            nodes = np.sort(nodes, axis=1)
            fresh = nodes >= 0
            fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
            r, c = np.nonzero(fresh)
            node = nodes[r, c]
            new = ~seen[rows[r], node]
            r, c, node = r[new], c[new], node[new]
            seen[rows[r], node] = True
            s = np.full(nodes.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.v[node], q[rows[r]])
            all_s = np.hstack([sims[rows], s])
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            all_i, all_o = np.hstack([ids[rows], nodes]), np.hstack([open_[rows], np.isfinite(s)])
            sims[rows], ids[rows] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
            open_[rows] = np.take_along_axis(all_o, best, 1) & np.isfinite(sims[rows])

        offer(rows, np.where(entry < n, entry, NONE))
        while len(rows := np.flatnonzero(open_.any(1))):
            s = np.where(open_[rows], sims[rows], -np.inf)
            pick = np.argpartition(-s, expand - 1, axis=1)[:, :expand]
            ok = np.isfinite(np.take_along_axis(s, pick, 1))
            node = np.take_along_axis(ids[rows], pick, 1)
            open_[rows[:, None], pick] = False
            near = links[np.where(ok, node, 0)]
            near = np.where(ok[:, :, None] & (near < n), near, NONE)
            offer(rows, near.reshape(len(rows), -1))
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), np.take_along_axis(ids, order, 1), NONE), sims

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, dtype=np.float32)
        return self._beam(0, q, self._down(q, 0, len(self.v)), width, len(self.v))
