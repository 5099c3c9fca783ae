"""A robust-pruned directed graph over unit vectors, built and searched in batches of queries with numpy.

Points are inserted in batches. A greedy search with a beam over the graph so far proposes neighbours for every point
of a batch; relaxed distance pruning (keep a candidate unless a kept one is ``alpha`` times nearer to it than the
point is) keeps diverse edges; reverse edges are added and pruned when a node has too many. Searching is the same
greedy search; for all points within a similarity the beam widens as long as they fill it. All points of a batch advance together, so that each step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NONE = -1


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = 20, beam: int = 32, alpha: float = 1.2, batch: int = 512, seed: int = 0):
        self.v = np.ascontiguousarray(vectors, dtype=np.float32)
        self.n = len(self.v)
        self.degree, self.most, self.beam, self.alpha, self.batch = degree, degree + degree // 2, beam, alpha, batch
        self.edges = np.full((self.n, self.most), NONE, dtype=np.int32)
        self.count = np.zeros(self.n, dtype=np.int32)
        self.order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.entry = np.zeros(0, dtype=np.int32)

    def build(self) -> Graph:
        """Insert all points, batch by batch."""
        at = 0
        while at < self.n:
            size = min(self.batch, max(64, at), self.n - at)
            new = self.order[at : at + size]
            own = self.v[new] @ self.v[new].T  # the points of a batch cannot find one another in the graph yet
            np.fill_diagonal(own, -2)
            if at == 0:
                mid = self.v[new].mean(0)
                self.entry = new[np.argsort(-(self.v[new] @ mid), kind="stable")[:1]]
                ids, sims = np.empty((size, 0), dtype=np.int32), np.empty((size, 0), dtype=np.float32)
            else:
                ids, sims = self.search(self.v[new], self.beam)
            k = min(size - 1, max(4, self.degree // 2)) if at else min(size - 1, 2 * self.degree)
            if k > 0:
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, new[best]], 1)
                sims = np.concatenate([sims, np.take_along_axis(own, best, 1)], 1)
            if ids.shape[1]:
                kept = self._prune(ids, sims, self.degree)
                self.edges[new, :] = NONE
                self.edges[new[:, None], np.arange(kept.shape[1])] = kept
                self.count[new] = (kept != NONE).sum(1)
                self._reverse(new, kept)
            at += size
        self._adopt()
        return self

    def _adopt(self) -> None:
        """Give every node that no path from the entry reaches an edge from the nearest node that a search for it meets
        and that has room, so that dense neighbourhoods, whose edges pruning thins out, stay reachable in whole."""
        seen = np.zeros(self.n, dtype=bool)
        front = self.entry
        while len(front):
            seen[front] = True
            front = np.unique(self.edges[front])
            front = front[front != NONE]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        for at in range(0, len(lost), self.batch):
            part = lost[at : at + self.batch]
            width = min(self.beam, self.n)
            while len(part):
                ids, sims = self.search(self.v[part], width)
                best = np.argsort(-sims, axis=1, kind="stable")
                left = []
                for r, x in enumerate(part):
                    near = ids[r, best[r]]
                    near = near[near != NONE]
                    near = near[self.count[near] < self.most]
                    if len(near) or width == self.n:
                        to = near[0] if len(near) else self.entry[0]
                        self.edges[to, min(self.count[to], self.most - 1)] = x
                        self.count[to] = min(self.count[to] + 1, self.most)
                    else:
                        left.append(x)
                part, width = np.array(left, dtype=np.int64), min(2 * width, self.n)

    def within(self, q: np.ndarray, near: float, beam: int, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, point, similarity) of the points at least ``near`` similar that beam searches meet, by parts; ``start`` is the
        node of a query that is a point of the graph itself, else NONE. A query
        whose near points fill over a third of its beam is searched again with a beam twice as wide, until they do not."""
        todo, width = np.arange(len(q)), min(beam, self.n)
        while len(todo):
            again = []
            step = max(8, self.batch * beam // max(beam, width))
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                ids, sims = self.search(q[part], width, max(3, width // 16), start[part])
                hit = (sims >= near) & (ids != NONE)
                full = (3 * hit.sum(1) > width) & (width < self.n)
                i, j = np.nonzero(hit & ~full[:, None])
                yield part[i], ids[i, j], sims[i, j]
                again.append(part[full])
            todo, width = np.concatenate(again), min(2 * width, self.n)

    def _prune(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Of candidates per row (NONE for no candidate) the ``degree`` that relaxed pruning keeps, nearest first."""
        sims = np.where(ids == NONE, -3, sims)
        c = min(ids.shape[1], 2 * degree + 4)
        if ids.shape[1] > c:
            top = np.argpartition(-sims, c - 1, axis=1)[:, :c]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
        x = self.v[ids]
        limit = 1 - (1 - sims) / self.alpha  # j falls if some kept i has sim(i, j) above this
        drop = np.matmul(x, x.transpose(0, 2, 1)) >= limit[:, None, :]
        alive = sims > -2.5
        taken = np.zeros(len(ids), dtype=np.int32)
        out = np.full((len(ids), degree), NONE, dtype=np.int32)
        for i in range(c):
            use = alive[:, i] & (taken < degree)
            r = np.flatnonzero(use)
            if not len(r):
                continue
            out[r, taken[r]] = ids[r, i]
            taken[r] += 1
            alive[r] &= ~drop[r, i]
        return out

    def _reverse(self, new: np.ndarray, kept: np.ndarray) -> None:
        i, j = np.nonzero(kept != NONE)
        src, dst = new[i], kept[i, j]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        nodes = dst[first]
        sizes = np.diff(np.r_[first, len(dst)])
        place = np.arange(len(dst)) - np.repeat(first, sizes)
        at = self.count[dst] + place
        fits = np.repeat(self.count[nodes] + sizes <= self.most, sizes)
        self.edges[dst[fits], at[fits]] = src[fits]
        ok = self.count[nodes] + sizes <= self.most
        self.count[nodes[ok]] += sizes[ok]
        over = np.flatnonzero(~ok)
        for part in np.array_split(over, max(1, len(over) // 1024)):
            if not len(part):
                continue
            width = int(sizes[part].max())
            extra = np.full((len(part), width), NONE, dtype=np.int32)
            for row, o in enumerate(part):
                extra[row, : sizes[o]] = src[first[o] : first[o] + sizes[o]]
            q = nodes[part]
            ids = np.concatenate([self.edges[q], extra], 1)
            same = np.sort(ids, 1)
            if (same[:, 1:] == same[:, :-1])[same[:, 1:] != NONE].any():
                for r in range(len(ids)):
                    _, f = np.unique(ids[r], return_index=True)
                    keep = np.zeros(ids.shape[1], dtype=bool)
                    keep[f] = True
                    ids[r][~keep] = NONE
            sims = np.einsum("bd,bcd->bc", self.v[q], self.v[ids])
            kept2 = self._prune(ids, sims, self.degree)
            self.edges[q, :] = NONE
            self.edges[q[:, None], np.arange(kept2.shape[1])] = kept2
            self.count[q] = (kept2 != NONE).sum(1)

    def search(self, q: np.ndarray, beam: int, wide: int = 3, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beams of all queries, unordered; NONE where a beam is not full. ``start`` gives each
        query a node of its own to begin at, NONE for none, beside the common entry."""
        b = len(q)
        ids = np.full((b, beam), NONE, dtype=np.int32)
        sims = np.full((b, beam), -2, dtype=np.float32)
        open_ = np.zeros((b, beam), dtype=bool)
        seen = np.zeros((b, self.n), dtype=bool)
        e = len(self.entry)
        ids[:, :e], sims[:, :e], open_[:, :e] = self.entry, q @ self.v[self.entry].T, True
        seen[:, self.entry] = True
        if start is not None and beam > e:
            r = np.flatnonzero((start != NONE) & ~np.isin(start, self.entry))
            ids[r, e], sims[r, e], open_[r, e] = start[r], np.einsum("nd,nd->n", self.v[start[r]], q[r]), True
            seen[r, start[r]] = True
        live = np.arange(b)
        w = min(wide, beam)
        while len(live):
            s = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-s, w - 1, axis=1)[:, :w]
            chosen = np.take_along_axis(s, pick, 1) > -3
            cur = np.take_along_axis(ids[live], pick, 1)
            open_[live[:, None], pick] = False
            nb = np.where(chosen[:, :, None], self.edges[cur], NONE).reshape(len(live), -1)
            ok = (nb != NONE) & ~seen[live[:, None], nb]
            r, c = np.nonzero(ok)
            x = nb[r, c]
            seen[live[r], x] = True
            key = r.astype(np.int64) * self.n + x
            by = np.argsort(key, kind="stable")
            r, x = r[by], x[by]
            if len(r):
                first = np.r_[True, key[by][1:] != key[by][:-1]]
                r, x = r[first], x[first]
                d = np.einsum("nd,nd->n", self.v[x], q[live[r]])
                better = d > sims[live[r]].min(1) if len(r) < 64 else d > sims[live].min(1)[r]
                r, x, d = r[better], x[better], d[better]
            if len(r):
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                sizes = np.diff(np.r_[start, len(r)])
                place = np.arange(len(r)) - np.repeat(start, sizes)
                rows = r[start]
                width = int(sizes.max())
                pos = np.repeat(np.arange(len(rows)), sizes)
                ni = np.full((len(rows), width), NONE, dtype=np.int32)
                ns = np.full((len(rows), width), -2, dtype=np.float32)
                ni[pos, place], ns[pos, place] = x, d
                g = live[rows]
                ai = np.concatenate([ids[g], ni], 1)
                as_ = np.concatenate([sims[g], ns], 1)
                ao = np.concatenate([open_[g], ni != NONE], 1)
                top = np.argpartition(-as_, beam - 1, axis=1)[:, :beam]
                ids[g], sims[g], open_[g] = np.take_along_axis(ai, top, 1), np.take_along_axis(as_, top, 1), np.take_along_axis(ao, top, 1)
            live = live[open_[live].any(1)]
        return ids, sims


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centres of a spherical k-means over a sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(sample[i : i + 1024] @ c.T, 1) for i in range(0, len(sample), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, at, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-9), c).astype(np.float32)
    return c
