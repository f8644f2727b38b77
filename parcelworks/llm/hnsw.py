"""A hierarchical navigable small-world graph over one shard's unit vectors (numpy, inside one task)."""

from __future__ import annotations

import io

import numpy as np


class Hnsw:
    """Level 0 holds all nodes, each level above about one in ``m`` of the level below. Rows of ``links[level]``
    are neighbours, -1 where there is none; a node's list is cut back to diverse neighbours when it is full."""

    def __init__(self, vectors: np.ndarray, m: int = 12, build_beam: int = 64, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.m, self.entry = vectors.astype(np.float32), m, entry
        self.seen, self.turn = np.zeros(len(vectors), np.int64), 0
        if links is not None:
            self.links = links
            return
        n = len(vectors)
        draw = np.random.default_rng(7).random(n)
        level = np.minimum((-np.log(1 - draw) / np.log(m)).astype(int), 12)
        self.links = [np.full((n, (4 if k == 0 else 2) * m), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.size = [np.zeros(n, np.int32) for _ in self.links]
        top = -1
        for i in range(n):
            at = np.array([self.entry])
            for k in range(top, level[i], -1):
                at = self._beam(self.x[i], at, 1, k)[0][:1]
            for k in range(min(top, level[i]), -1, -1):
                ids, sims = self._beam(self.x[i], at, build_beam, k)
                near = self._diverse(ids[:32], sims[:32], m)
                self.links[k][i, : len(near)], self.size[k][i] = near, len(near)
                for j in near:
                    self._add(k, j, i)
                at = ids
            if level[i] > top:
                top, self.entry = int(level[i]), i

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by falling similarity, those nearer to the node than to any chosen one; then the nearest of the rest."""
        if len(ids) <= most:
            return ids
        own = self.x[ids]
        between = own @ own.T
        closest, chosen, rest = np.full(len(ids), -2.0), [], []
        for i in range(len(ids)):
            if len(chosen) < most and closest[i] <= sims[i]:
                chosen.append(i)
                closest = np.maximum(closest, between[i])
            else:
                rest.append(i)
        return ids[chosen + rest[: most - len(chosen)]]

    def _add(self, level: int, node: int, new: int) -> None:
        links, size = self.links[level], self.size[level]
        if size[node] == links.shape[1]:
            sims = self.x[links[node]] @ self.x[node]
            order = np.argsort(-sims, kind="stable")
            kept = self._diverse(links[node][order], sims[order], links.shape[1] // 2)
            links[node] = -1
            links[node, : len(kept)], size[node] = kept, len(kept)
        links[node, size[node]] = new
        size[node] += 1

    def _beam(self, query: np.ndarray, start: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``width`` best nodes that a beam search meets, best first. A few
        nodes are expanded at a time, more in wide beams."""
        step = max(6, width // 12)
        self.turn += 1
        turn, seen, links, x = self.turn, self.seen, self.links[level], self.x
        ids = np.unique(start)
        seen[ids] = turn
        sims = x[ids] @ query
        order = np.argsort(-sims, kind="stable")[:width]
        ids, sims, open_ = ids[order], sims[order], np.ones(len(order), bool)
        while True:
            todo = np.flatnonzero(open_)[:step]
            if not len(todo):
                return ids, sims
            open_[todo] = False
            near = links[ids[todo]].ravel()
            near = near[near >= 0]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            near = np.unique(near)
            seen[near] = turn
            new = x[near] @ query
            if len(ids) >= width:
                better = new > sims[-1]
                near, new = near[better], new[better]
                if not len(near):
                    continue
            ids, sims = np.concatenate([ids, near]), np.concatenate([sims, new])
            order = np.argsort(-sims, kind="stable")[:width]
            ids, sims, open_ = ids[order], sims[order], np.concatenate([open_, np.ones(len(near), bool)])[order]

    def search(self, query: np.ndarray, width: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes of a beam search from the top; ``start`` is one more entry into level 0."""
        at = np.array([self.entry])
        for k in range(len(self.links) - 1, 0, -1):
            at = self._beam(query, at, 4, k)[0]
        return self._beam(query, at if start is None else np.append(at, start), width, 0)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, m=self.m, **{f"level{k}": a for k, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> Hnsw:
        with np.load(io.BytesIO(data)) as f:
            links = [f[f"level{k}"] for k in range(sum(x.startswith("level") for x in f.files))]
            return cls(vectors, int(f["m"]), links=links, entry=int(f["entry"]))


def _wide(index: Hnsw, query: np.ndarray, start: int | None, width: int, low: float) -> tuple[np.ndarray, np.ndarray]:
    """A search whose beam grows until some of it lies below ``low``, or it holds the whole shard."""
    while True:
        ids, sims = index.search(query, min(width, len(index.x)), start)
        if width >= len(index.x) or sims[-1] < low:
            return ids, sims
        width *= 4


def _exact(index: Hnsw, queries: np.ndarray, low: float, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All (query row, node) pairs of similarity ``low`` or more, by blocks of queries."""
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    for i in range(0, len(queries), block):
        at, node = np.nonzero(queries[i : i + block].astype(np.float32) @ index.x.T >= low)
        left.append(at + i)
        right.append(node)
    return np.concatenate(left), np.concatenate(right)


def near_links(
    index: Hnsw, queries: np.ndarray, same: bool, threshold: float, beam: int = 64, audits: int = 128, recall: float = 0.95
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(query row, node) pairs of cosine ``threshold`` or more (a hair below counts; the caller verifies), and what the last audit
    looked for and found. ``same``: the queries are the index's own vectors.

    A query's beam is widened while all of it lies within the threshold. An audit compares ``audits`` queries
    spread over the rows with an exact scan; while a link of theirs is missed, or less than ``recall`` of their
    ten nearest nodes found, all beams are doubled. Where a beam as wide as the shard still misses some (its graph
    is not connected), the queries are scanned exactly."""
    n, low = len(index.x), threshold - 1e-5
    sample = np.unique(np.linspace(0, len(queries) - 1, min(audits, len(queries))).astype(int))
    exact = queries[sample].astype(np.float32) @ index.x.T
    due = [(np.flatnonzero(sims >= threshold), np.argsort(-sims, kind="stable")[:10]) for sims in exact]
    asked = sum(len(links) + len(ten) for links, ten in due)
    while True:
        missed = met = 0
        for row, (links, ten) in zip(sample.tolist(), due, strict=True):
            ids = _wide(index, queries[row], row if same else None, beam, low)[0]
            missed += len(np.setdiff1d(links, ids))
            met += int(np.isin(ten, ids).sum())
        if not missed and met >= recall * sum(len(ten) for _, ten in due):
            break
        if beam >= n:
            return *_exact(index, queries, low), asked, asked
        beam *= 2
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    for i in range(len(queries)):
        ids, sims = _wide(index, queries[i], i if same else None, beam, low)
        good = ids[sims >= low]
        left.append(np.full(len(good), i))
        right.append(good)
    return np.concatenate(left), np.concatenate(right), asked, sum(len(links) for links, _ in due) + met
