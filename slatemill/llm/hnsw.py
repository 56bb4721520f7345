"""A navigable small-world graph over one shard of unit vectors, built and searched for many queries at a time."""
from __future__ import annotations

import numpy as np

DEGREE, BUILD_WIDTH, INSERT, EXPAND = 12, 32, 512, 4


class SmallWorld:
    """Layers of neighbour lists (-1: none). Layer l holds the nodes whose level is l or more; a search goes down the
    layers from node 0, which is in all of them. The lowest layer has twice the degree."""

    def __init__(self, v: np.ndarray, seed: int = 3):
        """`v`: unit rows, in random order."""
        self.v = v.astype(np.float32)
        n = len(v)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(np.int64)
        top = int(np.log(max(n, 2)) / np.log(DEGREE))
        self.level = np.minimum(level, top)
        self.level[:1] = top
        self.links = [np.full((n, 2 * DEGREE if layer == 0 else DEGREE), -1, dtype=np.int32) for layer in range(top + 1)]
        at, size = 0, 32
        while at < n:
            self._insert(np.arange(at, min(n, at + size)))
            at, size = at + size, min(INSERT, 2 * size)

    def _insert(self, new: np.ndarray) -> None:
        start = np.zeros((len(new), 1), dtype=np.int64)
        for layer in range(len(self.links) - 1, -1, -1):
            if new[0]:
                ids, sims = self._beam(layer, start, self.v[new], BUILD_WIDTH)
                start = ids[:, :1]
            else:
                ids, sims = np.zeros((len(new), 0), dtype=np.int64), np.zeros((len(new), 0), dtype=np.float32)
            here = np.flatnonzero(self.level[new] >= layer)
            if not len(here):
                continue
            own = new[here]
            near = self.v[own] @ self.v[own].T
            np.fill_diagonal(near, -np.inf)
            k = min(len(own), DEGREE)
            mates = np.argpartition(-near, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, mates, axis=1)
            ids = np.hstack([ids[here], own[mates]])
            sims = np.hstack([sims[here], near])
            picked = self._varied(ids, np.where(ids < 0, -np.inf, sims), DEGREE)
            self.links[layer][own, :DEGREE] = picked
            self._link_back(layer, own, picked)

    def _varied(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """For each row the m best candidates, those first that are nearer to the row's node than to a better one kept."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        valid = sims > -np.inf
        cv = self.v[np.where(valid, ids, 0)]
        gram = cv @ cv.transpose(0, 2, 1)
        keep, count = np.zeros(ids.shape, dtype=bool), np.zeros(len(ids), dtype=np.int64)
        for c in range(ids.shape[1]):
            rival = np.where(keep, gram[:, c, :], -np.inf).max(axis=1)
            keep[:, c] = valid[:, c] & (sims[:, c] > rival) & (count < m)
            count += keep[:, c]
        rank = np.where(valid, sims + 4 * keep, -np.inf)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(valid, best, axis=1), np.take_along_axis(ids, best, axis=1), -1)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def _link_back(self, layer: int, own: np.ndarray, picked: np.ndarray) -> None:
        links = self.links[layer]
        to, of = picked.reshape(-1), np.repeat(own, picked.shape[1])
        of, to = of[to >= 0], to[to >= 0]
        sim = np.einsum("ij,ij->i", self.v[to], self.v[of])
        order = np.lexsort((-sim, to))
        to, of = to[order], of[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        some = place < links.shape[1]                                     # a node met by very many keeps the nearest
        added = np.full((len(nodes), links.shape[1]), -1, dtype=np.int64)
        added[np.repeat(np.arange(len(nodes)), count)[some], place[some]] = of[some]
        for a in range(0, len(nodes), 1024):
            own_nodes = nodes[a:a + 1024]
            ids = np.hstack([links[own_nodes], added[a:a + 1024]])
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("nd,ncd->nc", self.v[own_nodes], self.v[np.maximum(ids, 0)])
            links[own_nodes] = self._varied(ids, np.where(ids < 0, -np.inf, sims), links.shape[1])

    def _beam(self, layer: int, start: np.ndarray, q: np.ndarray, width: int, hits_above: float | None = None):
        """Best `width` nodes of each query, as ids (-1: none) and similarities, falling. With `hits_above` also the
        (query, node) pairs at least that near that were met on the way."""
        links, rows = self.links[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.v)), dtype=bool)
        seen[rows[:, None], start] = True
        ids = np.full((len(q), width), -1, dtype=np.int64)
        sims = np.full((len(q), width), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), width), dtype=bool)
        ids[:, :start.shape[1]], open_[:, :start.shape[1]] = start, True
        sims[:, :start.shape[1]] = np.einsum("qd,qsd->qs", q, self.v[start])
        met = [(rows[h[0]], start[h]) for h in [np.nonzero(sims[:, :start.shape[1]] >= hits_above)]] if hits_above is not None else []
        live = rows
        while len(live):
            now = np.where(open_[live], sims[live], -np.inf)
            e = min(EXPAND, width)
            pick = np.argpartition(-now, e - 1, axis=1)[:, :e]
            valid = np.take_along_axis(now, pick, axis=1) > -np.inf
            open_[live[:, None], pick] = False
            near = links[np.take_along_axis(ids[live], pick, axis=1)]
            near = np.where(valid[:, :, None], near, -1).reshape(len(live), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            node = near[r, c].astype(np.int64)
            seen[live[r], node] = True
            s = np.full(near.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[live[r]], self.v[node])
            if hits_above is not None:
                h = s[r, c] >= hits_above
                met.append((live[r[h]], node[h]))
            every_s, every_i = np.hstack([sims[live], s]), np.hstack([ids[live], np.where(fresh, near, -1)])
            every_o = np.hstack([open_[live], fresh])
            best = np.argpartition(-every_s, width - 1, axis=1)[:, :width]
            sims[live], ids[live], open_[live] = (np.take_along_axis(x, best, axis=1) for x in (every_s, every_i, every_o))
            live = live[open_[live].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        if hits_above is None:
            return ids, sims
        return ids, sims, (np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]))

    def within(self, q: np.ndarray, above: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity `above` or more, found with a beam of `width`, and whether each query's
        beam was still full of such nodes when it ended."""
        q = q.astype(np.float32)
        _, sims, (a, b) = self._beam(0, self._start(q), q, min(width, len(self.v)), above)
        return a, b, sims[:, -1] >= above

    def nearest(self, q: np.ndarray, width: int) -> np.ndarray:
        """The `width` best nodes that a beam of that width finds for each query (-1: none)."""
        q = q.astype(np.float32)
        return self._beam(0, self._start(q), q, min(width, len(self.v)))[0]

    def _start(self, q: np.ndarray) -> np.ndarray:
        start = np.zeros((len(q), 1), dtype=np.int64)
        for layer in range(len(self.links) - 1, 0, -1):
            start = self._beam(layer, start, q, EXPAND)[0][:, :1]
        return start

    def arrays(self) -> dict[str, np.ndarray]:
        return {"level": self.level, **{f"links{i}": x for i, x in enumerate(self.links)}}

    @classmethod
    def of(cls, v: np.ndarray, arrays: dict[str, np.ndarray]) -> SmallWorld:
        g = cls.__new__(cls)
        g.v, g.level = v.astype(np.float32), arrays["level"]
        g.links = [arrays[f"links{i}"] for i in range(len(arrays) - 1)]
        return g
