"""Hierarchical navigable small-world graph over one shard, in flat neighbour arrays.

A graph has one ``int32`` array of neighbour positions for each level, a row of
fixed width for each node of that level.  Inserts and searches run for blocks
of vectors at once: every step of a block expands the best open candidates of
all its searches in one gather and one matrix product.
"""

from __future__ import annotations

import numpy as np

#: Candidates that a search opens at a time.
STEP = 3


class FlatGraph:
    """Unit vectors, linked at ``levels + 1`` levels; similarity is the inner product."""

    def __init__(self, vectors: np.ndarray, m: int = 8, ef_build: int = 32, block: int = 256, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.n, self.m, self.ef_build = len(self.x), m, ef_build
        rng = np.random.default_rng(seed)
        draw = np.floor(-np.log(1.0 - rng.random(self.n)) / np.log(m)).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.level = np.minimum(draw, 6)
        # nodes of high levels go in first, so that the upper levels stand before the mass arrives
        self.order = np.argsort(-self.level, kind="stable")
        self.top = int(self.level.max()) if self.n else 0
        self.links = [np.full((self.n, 2 * m if lv == 0 else m), -1, np.int32) for lv in range(self.top + 1)]
        self.entry = int(self.order[0]) if self.n else -1
        self._seen = np.zeros((block, self.n), dtype=bool)
        self._build(block)

    def _build(self, block: int) -> None:
        at = min(self.n, 1)
        while at < self.n:
            take = min(block, max(1, at // 2), self.n - at)
            self._insert(self.order[at : at + take])
            at += take

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        start = np.full((len(new), 1), self.entry, np.int32)
        among = q @ q.T
        np.fill_diagonal(among, -2.0)
        for lv in range(self.top, -1, -1):
            here = self.level[new] >= lv
            ef = self.ef_build if here.any() else 1
            ids, sims = self.beam(q, start, lv, ef)
            start = ids[:, : max(1, min(4, ids.shape[1]))]
            if not here.any():
                continue
            # candidates: what the search found, and the block's own members at this level
            rows = np.flatnonzero(here)
            inner = among[np.ix_(rows, rows)]
            width = min(2 * self.m, len(rows))
            near = np.argpartition(-inner, width - 1, axis=1)[:, :width]
            inner_sims = np.take_along_axis(inner, near, 1)
            cand = np.concatenate([ids[rows], np.where(inner_sims > -2, new[rows][near], -1)], 1).astype(np.int32)
            score = np.concatenate([sims[rows], inner_sims], 1)
            chosen = self._spread(cand, score, self.m)
            self.links[lv][new[rows], : chosen.shape[1]] = chosen
            self._link_back(new[rows], chosen, lv)

    def _spread(self, cand: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
        """The best candidates that are nearer to the node than to one taken before; free places go to the rest."""
        order = np.argsort(-np.where(cand < 0, -3.0, score), axis=1)[:, : 3 * keep]
        cand = np.take_along_axis(cand, order, 1)
        score = np.where(cand < 0, -3.0, np.take_along_axis(score, order, 1))
        v = self.x[np.maximum(cand, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        rows, width = cand.shape
        taken = np.zeros((rows, width), dtype=bool)
        for j in range(width):
            crowded = ((between[:, j, :] > score[:, j, None]) & taken).any(1)
            taken[:, j] = ~crowded & (cand[:, j] >= 0) & (taken.sum(1) < keep)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, :keep]
        out = np.take_along_axis(cand, rank, 1)
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, lv: int) -> None:
        width = self.links[lv].shape[1]
        src = np.repeat(nodes, chosen.shape[1]).astype(np.int32)
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads, first, counts = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(heads), int(counts.max())), -1, np.int32)
        extra[np.repeat(np.arange(len(heads)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
        cand = np.concatenate([self.links[lv][heads], extra], 1)
        used = (cand >= 0).sum(1)
        simple = used <= width
        if simple.any():
            packed = np.take_along_axis(cand[simple], np.argsort(cand[simple] < 0, axis=1, kind="stable"), 1)
            self.links[lv][heads[simple]] = packed[:, :width]
        full = np.flatnonzero(~simple)
        for part in np.array_split(full, max(1, len(full) // 512)):
            if len(part):
                c = cand[part]
                sims = np.einsum("ijk,ik->ij", self.x[np.maximum(c, 0)], self.x[heads[part]])
                self.links[lv][heads[part]] = -1
                kept = self._spread(c, sims, width)
                self.links[lv][heads[part], : kept.shape[1]] = kept

    def beam(self, q: np.ndarray, start: np.ndarray, lv: int, ef: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of up to ``ef`` near nodes at level ``lv``, best first, -1 where there are fewer."""
        count, links = len(q), self.links[lv]
        seen = self._seen[:count]
        seen[:] = False
        ids = np.full((count, ef), -1, np.int32)
        sims = np.full((count, ef), -3.0, np.float32)
        opened = np.ones((count, ef), dtype=bool)
        width = min(ef, start.shape[1])
        first = start[:, :width]
        ids[:, :width] = first
        sims[:, :width] = np.where(first < 0, -3.0, np.einsum("ijk,ik->ij", self.x[np.maximum(first, 0)], q))
        opened[:, :width] = first < 0
        r, c = np.nonzero(first >= 0)
        seen[r, first[r, c]] = True
        live = np.arange(count)
        step = min(step, ef)
        while len(live):
            closed_sims = np.where(opened[live], -4.0, sims[live])
            pick = np.argpartition(-closed_sims, step - 1, axis=1)[:, :step] if step < ef else np.argsort(-closed_sims, axis=1)
            good = np.take_along_axis(closed_sims, pick, 1) > -3.0
            going = good.any(1)
            if not going.all():
                live, pick, good = live[going], pick[going], good[going]
                if not len(live):
                    break
            opened[live[:, None], pick] = True
            at = np.where(good, ids[live[:, None], pick], -1)
            near = np.where(at[:, :, None] >= 0, links[np.maximum(at, 0)], -1).reshape(len(live), -1)
            rows, cols = np.nonzero(near >= 0)
            nodes = near[rows, cols]
            fresh = ~seen[live[rows], nodes]
            rows, nodes = rows[fresh], nodes[fresh]
            # the same node may come from two expanded candidates of one search
            code = rows.astype(np.int64) * self.n + nodes
            code.sort()
            code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
            rows, nodes = code // self.n, (code % self.n).astype(np.int32)
            if not len(rows):
                continue
            seen[live[rows], nodes] = True
            got = np.einsum("ij,ij->i", self.x[nodes], q[live[rows]])
            worst = sims[live].min(1)
            better = got > worst[rows]
            rows, nodes, got = rows[better], nodes[better], got[better]
            if not len(rows):
                continue
            counts = np.bincount(rows, minlength=len(live))
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            wide = int(counts.max())
            new_ids = np.full((len(live), wide), -1, np.int32)
            new_sims = np.full((len(live), wide), -3.0, np.float32)
            new_ids[rows, offset] = nodes
            new_sims[rows, offset] = got
            all_ids = np.concatenate([ids[live], new_ids], 1)
            all_sims = np.concatenate([sims[live], new_sims], 1)
            all_open = np.concatenate([opened[live], new_ids < 0], 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, k: int, ef: int = 32, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest of each query; ``own`` starts a query at its own node instead of the top level."""
        out_ids, out_sims = [], []
        block = len(self._seen)
        for at in range(0, len(q), block):
            part = q[at : at + block]
            if own is not None:
                start = own[at : at + block].astype(np.int32)[:, None]
            else:
                start = np.full((len(part), 1), self.entry, np.int32)
                for lv in range(self.top, 0, -1):
                    start = self.beam(part, start, lv, 4, 1)[0]
            ids, sims = self.beam(part, start, 0, max(ef, k))
            out_ids.append(ids[:, :k])
            out_sims.append(sims[:, :k])
        if not out_ids:
            return np.zeros((0, k), np.int32), np.zeros((0, k), np.float32)
        return np.concatenate(out_ids), np.concatenate(out_sims)
