"""Hierarchical navigable small-world graph over unit vectors, built and searched in numpy batches."""

from __future__ import annotations

import numpy as np

LINKS = 12  # links a new node chooses; the bottom layer keeps twice as many
BUILD_BEAM = 48
BATCH = 256
WIDEN = 2
WIDEST = 8  # a beam of this part of the graph is as wide as the graph itself
PROBES = 256  # moved copies of nodes that a beam must find the neighbours of
STRIDE = 3  # beam entries expanded at once


class Graph:
    """Layers of neighbour lists (-1: none). Nodes are in insertion order; layer k holds the nodes of level k and up."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], levels: np.ndarray) -> None:
        self.vectors, self.layers, self.levels = vectors, layers, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> Graph:
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int), 6)
        levels[0] = levels.max(initial=0)  # the first node is the entry of every search
        layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        graph = cls(vectors, layers, levels)
        done = 1
        while done < n:
            stop = min(n, done + min(BATCH, max(1, done)))
            graph._insert(np.arange(done, stop))
            done = stop
        return graph

    def _insert(self, new: np.ndarray) -> None:
        entry = np.zeros(len(new), dtype=np.int64)
        for level in range(len(self.layers) - 1, -1, -1):
            own = self.levels[new] >= level
            beam = BUILD_BEAM if own.any() else 1
            ids, sims = self._search(self.vectors[new], entry, beam, level, int(new[0]))
            entry = ids[:, 0].copy()
            if not own.any():
                continue
            rows = np.flatnonzero(own)
            among = self.vectors[new[rows]] @ self.vectors[new[rows]].T
            np.fill_diagonal(among, -2)
            ids = np.concatenate([ids[rows], np.broadcast_to(new[rows], (len(rows), len(rows)))], axis=1)
            sims = np.concatenate([sims[rows], among], axis=1)
            width = min(BUILD_BEAM, ids.shape[1])
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            chosen = self._diverse(ids, sims, LINKS)
            self.layers[level][new[rows], :LINKS] = chosen
            self._link_back(level, new[rows], chosen)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Nearest candidates first, each unless it is nearer to a chosen one; then the nearest of the rest fill up."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        real = (ids >= 0) & (sims > -1.5)
        rows, width = ids.shape
        own = self.vectors[np.maximum(ids, 0)]
        pair = own @ own.transpose(0, 2, 1)
        taken = np.zeros((rows, width), dtype=bool)
        closest = np.full((rows, width), -2.0, dtype=pair.dtype)
        for c in range(width):
            free = real[:, c] & (taken.sum(axis=1) < most) & (sims[:, c] > closest[:, c])
            taken[:, c] = free
            closest = np.where(free[:, None], np.maximum(closest, pair[:, c, :]), closest)
        rank = np.where(taken, np.arange(width), np.where(real, width + np.arange(width), 3 * width))
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((rows, most), -1, dtype=np.int32)
        good = np.take_along_axis(real, first, 1)
        out[:, : first.shape[1]] = np.where(good, np.take_along_axis(ids, first, 1), -1)
        return out

    def _link_back(self, level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        layer = self.layers[level]
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel().astype(np.int64)
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, start, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        added = np.full((len(who), most), -1, dtype=np.int64)
        spot = np.arange(len(target)) - np.repeat(start, count)
        added[np.repeat(np.arange(len(who)), count), spot] = source
        ids = np.concatenate([layer[who].astype(np.int64), added], axis=1)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        for part in range(0, len(who), BATCH):
            own = ids[part : part + BATCH]
            sims = np.einsum("rcd,rd->rc", self.vectors[np.maximum(own, 0)], self.vectors[who[part : part + BATCH]])
            sims[own < 0] = -2
            layer[who[part : part + BATCH]] = self._diverse(own, sims, layer.shape[1])

    def _search(self, queries: np.ndarray, entry: np.ndarray, beam: int, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, cosines), best first, of all queries at once in one layer of the first `size` nodes."""
        count, layer = len(queries), self.layers[level]
        ids = np.full((count, beam), -1, dtype=np.int64)
        sims = np.full((count, beam), -2, dtype=np.float32)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entry])
        open_ = ids >= 0
        seen = np.zeros((count, size), dtype=bool)
        seen[np.arange(count), entry] = True
        live = np.arange(count)
        while len(live):
            stride = min(STRIDE, beam)
            waiting = np.where(open_[live], sims[live], -3)
            best = np.argpartition(-waiting, stride - 1, axis=1)[:, :stride] if stride < beam else np.argsort(-waiting, axis=1)
            good = np.take_along_axis(open_[live], best, 1)
            alive = good.any(axis=1)
            live, best, good = live[alive], best[alive], good[alive]
            if not len(live):
                break
            picked = np.where(good, np.take_along_axis(ids[live], best, 1), -1)
            open_[live[:, None], best] = False
            near = np.where(picked[:, :, None] >= 0, layer[np.maximum(picked, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & (near < size)
            fresh &= ~seen[live[:, None], np.maximum(np.minimum(near, size - 1), 0)]
            row, column = np.nonzero(fresh)
            found = near[row, column]
            seen[live[row], found] = True
            score = np.full(near.shape, -2, dtype=np.float32)
            score[row, column] = np.einsum("rd,rd->r", queries[live[row]], self.vectors[found])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], score], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            open_[live] = np.take_along_axis(all_open, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Descend the layers with a beam of one, then search the bottom layer."""
        entry = np.zeros(len(queries), dtype=np.int64)
        for level in range(len(self.layers) - 1, 0, -1):
            entry = self._search(queries, entry, 1, level, len(self.vectors))[0][:, 0]
        return self._search(queries, entry, min(beam, len(self.vectors)), 0, len(self.vectors))

    def within(self, queries: np.ndarray, least: float, beam: int, audits: int = 32, recall: float = 1.0, widest: int = WIDEST, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with a cosine of at least `least`.

        A graph of at most `widest` times the beam, which only a very small shard or a much widened beam has, is compared exhaustively. In a larger one, the beam is
        first widened until audited queries, and copies of nodes moved almost as far as `least` allows, miss no more neighbours
        than the recall allows. Only then are all queries searched, and those that find any node but their `own` (-1: none), or
        whose own node another query finds or they themselves do not, are compared with all nodes, so that they miss none.
        """
        rest = np.arange(len(queries))
        pairs = [(rest[:0], rest[:0])]
        if widest * beam < len(self.vectors):
            sample = queries[np.unique(np.linspace(0, len(queries) - 1, min(audits, len(queries))).astype(int))]
            tried = [(v, (v @ self.vectors.T >= least).sum(axis=1)) for v in (sample, self._probes(least))]
            while widest * beam < len(self.vectors) and any((self.search(v, beam)[1] >= least).sum() < recall * np.minimum(known, beam).sum() for v, known in tried):
                beam *= WIDEN
        if widest * beam < len(self.vectors):
            own = np.full(len(queries), -1) if own is None else own
            for part in range(0, len(queries), BATCH):
                ids, sims = self.search(queries[part : part + BATCH], beam)
                row, column = np.nonzero((sims >= least) & (ids >= 0))
                pairs.append((row + part, ids[row, column]))
            query, node = (np.concatenate(x) for x in zip(*pairs, strict=True))
            other = node != own[query]
            linked = np.zeros(len(queries), dtype=bool)
            linked[query[other]] = True
            linked |= (own >= 0) & (np.isin(own, node[other]) | ~np.isin(np.arange(len(queries)), query[~other]))
            pairs = [(query[~linked[query]], node[~linked[query]])]
            rest = np.flatnonzero(linked)
        while len(rest):
            found = []
            for part in range(0, len(rest), BATCH):
                some = rest[part : part + BATCH]
                row, node = np.nonzero(queries[some] @ self.vectors.T >= least)
                found.append((some[row], node))
            pairs += found
            if widest * beam >= len(self.vectors):
                break
            rest = np.flatnonzero(~linked & (own >= 0) & np.isin(own, np.concatenate([node for _, node in found])))
            linked[rest] = True
            pairs[0] = tuple(x[~linked[pairs[0][0]]] for x in pairs[0])
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def _probes(self, least: float, seed: int = 1) -> np.ndarray:
        """Some nodes, each moved by nine tenths of what its cosine may fall."""
        nodes = self.vectors[np.unique(np.linspace(0, len(self.vectors) - 1, min(PROBES, len(self.vectors))).astype(int))].astype(np.float64)
        away = np.random.default_rng(seed).normal(size=nodes.shape)
        away -= (away * nodes).sum(axis=1, keepdims=True) * nodes
        away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-12)
        cosine = 1 - 0.9 * (1 - least)
        return (cosine * nodes + np.sqrt(1 - cosine * cosine) * away).astype(np.float32)
