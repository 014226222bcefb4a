"""Hierarchical navigable small-world graphs, one per shard, as flat neighbour arrays.

A graph has layers of geometrically falling size. Every layer keeps, for each of its nodes, a fixed-width row of
neighbour numbers (-1 where there are fewer). Nodes are inserted in batches that double, those of high layers first: each
batch is searched in the graph so far, its members see each other too, the diversity rule of the method picks
neighbours among what was found, and reverse links keep every node reachable. Vectors must have equal length for inner
products to order neighbours as distances do; ``level_norms`` makes them so.

Searches run for a block of queries in step: each step opens the best few unopened nodes of every beam.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16
CANDIDATES = 48
BATCH = 1_024
WIDE = 8  # nodes of a beam opened in one step


def level_norms(vectors: np.ndarray) -> np.ndarray:
    """One more column brings every row to the largest norm: inner products with (q, 0) keep their order."""
    square = (vectors.astype(np.float64) ** 2).sum(1)
    extra = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.concatenate([vectors, extra[:, None].astype(np.float32)], 1)


def diverse(v: np.ndarray, near: np.ndarray, value: np.ndarray, degree: int) -> np.ndarray:
    """Which of each row's candidates, nearest first, to keep: those nearer to the row's node than to any kept one; the nearest four always."""
    cross = np.matmul(v[near], v[near].transpose(0, 2, 1))
    kept = np.zeros(near.shape, bool)
    closest = np.full(near.shape, -np.inf, np.float32)  # nearness to what is already kept
    for j in range(near.shape[1]):
        kept[:, j] = (value[:, j] > closest[:, j]) & (kept.sum(1) < degree)
        closest = np.where(kept[:, j, None], np.maximum(closest, cross[:, j]), closest)
    kept[:, :4] = True
    return kept & (value > -np.inf)


class Layer:
    """Neighbour rows of a layer while it is built, nearest first, with the inner products."""

    def __init__(self, n: int, own: np.ndarray, degree: int):
        self.degree, self.width = degree, 2 * degree
        self.row = np.full(n, -1, np.int64)
        self.row[own] = np.arange(len(own))
        self.links = np.full((len(own), self.width), -1, np.int32)
        self.near = np.full((len(own), self.width), -np.inf, np.float32)

    def link(self, v: np.ndarray, own: np.ndarray, near: np.ndarray, value: np.ndarray, most: int) -> None:
        """Neighbours for the new nodes ``own`` among the candidates ``near``, and the links back."""
        order = np.argsort(-value, axis=1, kind="stable")[:, :most]
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        for a in range(0, len(own), 256):
            kept = diverse(v, near[a : a + 256], value[a : a + 256], self.degree)
            value[a : a + 256][~kept] = -np.inf
        r, c = np.nonzero(value > -np.inf)
        a, b, s = own[r], near[r, c], value[r, c]
        a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        _, first = np.unique(a * len(v) + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        ok = place < self.width
        rows = self.row[a[begin]]
        at = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(a))))[ok]
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            mine = ok.nonzero()[0][(at >= lo) & (at < lo + 512)]
            wide = int(place[mine].max(initial=0)) + 1
            new, new_s = np.full((len(part), wide), -1, np.int32), np.full((len(part), wide), -np.inf, np.float32)
            which = at[(at >= lo) & (at < lo + 512)] - lo
            new[which, place[mine]], new_s[which, place[mine]] = b[mine], s[mine]
            all_ids, all_s = np.concatenate([self.links[part], new], 1), np.concatenate([self.near[part], new_s], 1)
            order = np.argsort(-all_s, axis=1, kind="stable")
            all_ids, all_s = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_s, order, 1)
            full = np.flatnonzero((all_s > -np.inf).sum(1) > self.width)
            for x in range(0, len(full), 128):  # too many: the diverse ones stay, then the nearest
                y = full[x : x + 128]
                kept = diverse(v, all_ids[y], all_s[y], self.width)
                rank = np.argsort(~kept, axis=1, kind="stable")[:, : self.width]
                rank.sort(axis=1)
                all_ids[y, : self.width], all_s[y, : self.width] = np.take_along_axis(all_ids[y], rank, 1), np.take_along_axis(all_s[y], rank, 1)
            self.links[part], self.near[part] = all_ids[:, : self.width], all_s[:, : self.width]


class Graph:
    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.nodes, self.links = vectors, nodes, links  # links[l]: rows for nodes[l], numbers of rows in vectors

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, ef: int = CANDIDATES, seed: int = 7) -> Graph:
        n, rng = len(vectors), np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(n).clip(1e-12)) / np.log(degree)).astype(int)
        order = rng.permutation(n)
        order = order[np.argsort(-level[order], kind="stable")]
        top = int(level.max(initial=0))
        while top and (level >= top).sum() < 2:  # a layer of one node leads nowhere
            top -= 1
        nodes = [np.sort(np.flatnonzero(level >= k)) for k in range(top + 1)]
        layers = [Layer(n, own, degree * (1 if k else 2)) for k, own in enumerate(nodes)]
        self = cls(vectors, nodes, [x.links for x in layers])
        at = 0
        while at < n:
            batch = order[at : at + min(BATCH, max(64, at))]
            self._insert(batch, level, layers, order[:1] if at else None, ef)
            at += len(batch)
        self.links = [x.links for x in layers]
        return self

    def _insert(self, batch: np.ndarray, level: np.ndarray, layers: list[Layer], entry: np.ndarray | None, ef: int) -> None:
        v = self.vectors
        start = None if entry is None else np.repeat(entry[None], len(batch), 0)
        for k in range(len(layers) - 1, -1, -1):
            here = np.flatnonzero(level[batch] >= k)
            found = np.full((len(batch), 0), -1, np.int64)
            if start is not None:
                wide = len(here) > 0
                found = self._blocks(v[batch], k, start, ef if wide else 4, WIDE if wide else 1)[0]
                start = found[:, :4]
            if not len(here):
                continue
            own = batch[here]
            near, s = found[here], np.full((len(here), found.shape[1]), -np.inf, np.float32)
            for a in range(0, len(here), 256):
                part = near[a : a + 256]
                s[a : a + 256] = np.where(part < 0, -np.inf, np.einsum("qd,qkd->qk", v[own[a : a + 256]], v[part]))
            each = v[own] @ v[own].T
            np.fill_diagonal(each, -np.inf)
            c = min(ef, len(own) - 1)
            if c > 0:
                pick = np.argpartition(-each, c - 1, axis=1)[:, :c]
                near, s = np.concatenate([near, own[pick]], 1), np.concatenate([s, np.take_along_axis(each, pick, 1)], 1)
            if near.shape[1]:
                layers[k].link(v, own, near, s, ef)

    def _blocks(self, q: np.ndarray, layer: int, start: np.ndarray, ef: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """``_beam`` for any number of queries, in blocks whose marks of seen nodes stay small."""
        step = max(1, min(256, 8_000_000 // max(1, len(self.vectors))))
        ef = max(1, min(ef, len(self.vectors)))
        parts = [self._beam(q[a : a + step], layer, start[a : a + step, :ef], ef, min(wide, ef)) for a in range(0, len(q), step)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _beam(self, q: np.ndarray, layer: int, start: np.ndarray, ef: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        v, own, links = self.vectors, self.nodes[layer], self.links[layer]
        row_of = None
        if len(own) < len(v):
            row_of = np.full(len(v) + 1, -1, np.int64)
            row_of[own] = np.arange(len(own))
        m, k = len(q), start.shape[1]
        ids = np.full((m, ef), -1, np.int32)
        sims, todo = np.full((2, m, ef), -np.inf, np.float32)  # todo: the same for nodes not opened yet
        ids[:, :k] = start
        sims[:, :k] = todo[:, :k] = np.where(start < 0, -np.inf, np.einsum("qd,qkd->qk", q, v[start]))
        base = np.arange(m) * (len(v) + 1)
        seen = np.zeros(m * (len(v) + 1), bool)
        seen[len(v) :: len(v) + 1] = True  # where number -1 falls
        seen[base[:, None] + start] = True
        live, last_ids, last_sims = np.arange(m), np.empty_like(ids), np.empty_like(sims)
        while True:
            open_ = np.argpartition(todo, -wide, axis=1)[:, -wide:]
            has = np.take_along_axis(todo, open_, 1) > -np.inf
            alive = has.any(1)
            if not alive.all():
                last_ids[live[~alive]], last_sims[live[~alive]] = ids[~alive], sims[~alive]
                live, base, q, ids, sims, todo, open_, has = (x[alive] for x in (live, base, q, ids, sims, todo, open_, has))
            if not len(live):
                break
            at = np.where(has, np.take_along_axis(ids, open_, 1), -1)
            np.put_along_axis(todo, open_, -np.inf, 1)
            if row_of is not None:
                at = row_of[at]
            found = links[at]
            found[at < 0] = -1
            found = found.reshape(len(live), -1)
            mark = (base[:, None] + found).ravel()
            new = np.flatnonzero(~seen[mark])  # a node found twice in one step is here twice
            r, got, mark = new // found.shape[1], found.ravel()[new], mark[new]
            seen[mark] = True
            near = np.einsum("kd,kd->k", np.take(q, r, 0), np.take(v, got, 0))
            better = np.flatnonzero(near > sims.min(1)[r])
            better = better[np.unique(mark[better], return_index=True)[1]]
            if not len(better):
                continue
            r, got, near = r[better], got[better], near[better]
            count = np.bincount(r, minlength=len(live))
            place = ef + np.arange(len(r)) - (np.cumsum(count) - count)[r]
            more = int(count.max())
            all_ids, (all_sims, all_todo) = np.full((len(live), ef + more), -1, np.int32), np.full((2, len(live), ef + more), -np.inf, np.float32)
            all_ids[:, :ef], all_sims[:, :ef], all_todo[:, :ef] = ids, sims, todo
            all_ids[r, place], all_sims[r, place], all_todo[r, place] = got, near, near
            best = np.argpartition(all_sims, more, axis=1)[:, more:]
            ids, sims, todo = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_todo))
        order = np.argsort(-last_sims, axis=1, kind="stable")
        return np.take_along_axis(last_ids, order, 1).astype(np.int64), np.take_along_axis(last_sims, order, 1)

    def search(self, q: np.ndarray, ef: int, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of up to ``ef`` near rows for every query, nearest first, -1 where there are none."""
        if not len(self.vectors) or not len(q):
            ef = max(1, min(ef, len(self.vectors)))
            return np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), -np.inf, np.float32)
        start = np.repeat(self.nodes[-1][None, :1], len(q), 0)
        for layer in range(len(self.nodes) - 1, 0, -1):
            start = self._blocks(q, layer, start, 4, 1)[0]
        return self._blocks(q, 0, start, ef, wide)

    def dump(self) -> dict[str, bytes]:
        """Flat arrays: sizes of layers, their nodes, widths of rows, rows, vectors."""
        return {
            "sizes": np.array([len(x) for x in self.nodes], "<i8").tobytes(), "nodes": np.concatenate(self.nodes).astype("<i4").tobytes(),
            "widths": np.array([x.shape[1] for x in self.links], "<i8").tobytes(), "links": np.concatenate([x.ravel() for x in self.links]).astype("<i4").tobytes(),
            "vectors": self.vectors.astype("<f4").tobytes(),
        }

    @classmethod
    def load(cls, parts: dict[str, bytes], dim: int, vectors: np.ndarray | None = None) -> Graph:
        """From flat arrays; ``vectors`` in place of those among them, where they are kept in another form."""
        sizes, widths = np.frombuffer(parts["sizes"], "<i8"), np.frombuffer(parts["widths"], "<i8")
        flat, rows = np.frombuffer(parts["nodes"], "<i4").astype(np.int64), np.frombuffer(parts["links"], "<i4")
        nodes, links, a, b = [], [], 0, 0
        for n, w in zip(sizes, widths, strict=True):
            nodes.append(flat[a : a + n])
            links.append(rows[b : b + n * w].reshape(n, w))
            a, b = a + n, b + n * w
        return cls(np.frombuffer(parts["vectors"], "<f4").reshape(-1, dim) if vectors is None else vectors, nodes, links)


def audited_search(graph: Graph, q: np.ndarray, k: int, ef: int, least: float = 0.97, sample: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Search whose beam grows, twofold and then by half, until a sample of the queries, compared with all rows of the shard, reaches recall ``least``."""
    n = len(graph.vectors)
    probe = np.unique(np.linspace(0, len(q) - 1, min(sample, len(q))).astype(int))
    exact = q[probe] @ graph.vectors.T
    k = min(k, n)
    bar = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
    while True:
        if ef < n:
            sims = graph.search(q[probe], ef)[1][:, :k]
            if (sims >= bar[:, None] - 1e-5).mean() < least:
                ef += max(ef // 2, 64)
                continue
        return graph.search(q, ef)
