"""A hierarchical navigable small-world graph in numpy, searched and grown for many vectors at once."""

from __future__ import annotations

import io

import numpy as np

#: Neighbours of a node on the upper layers and on the ground layer.
UPPER, GROUND = 12, 24
#: Beam while building, batch of insertions, queries searched together, new neighbours that a node looks at for one batch.
BUILD_BEAM, BATCH, TOGETHER, ARRIVALS = 48, 512, 512, 24
NONE = -1


def search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes that best-first search finds for each query from its entry nodes; (ids, cosines), best first, NONE where there are fewer."""
    many = len(queries)
    ids = np.full((many, beam), NONE, dtype=np.int32)
    cosines = np.full((many, beam), -np.inf, dtype=np.float32)
    open_ = np.zeros((many, beam), dtype=bool)
    seen = np.zeros((many, len(vectors)), dtype=bool)
    width = min(beam, entries.shape[1])
    start = entries[:, :width]
    ids[:, :width] = start
    cosines[:, :width] = np.where(start >= 0, np.einsum("qd,qed->qe", queries, vectors[np.maximum(start, 0)]), -np.inf)
    open_[:, :width] = start >= 0
    seen[np.arange(many)[:, None], np.maximum(start, 0)] = True
    going = np.arange(many)
    while len(going):
        waiting = np.where(open_[going], cosines[going], -np.inf)
        slot = waiting.argmax(1)
        alive = waiting[np.arange(len(going)), slot] > -np.inf
        going, slot = going[alive], slot[alive]
        if not len(going):
            break
        open_[going, slot] = False
        near = links[ids[going, slot]]
        fresh = (near >= 0) & ~seen[going[:, None], near]
        seen[going[:, None], np.maximum(near, 0)] |= near >= 0
        found = np.where(fresh, np.matmul(vectors[np.maximum(near, 0)], queries[going][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        better = found.max(1) > cosines[going].min(1)
        some = going[better]
        if len(some):
            all_ids = np.concatenate((ids[some], near[better]), axis=1)
            all_cosines = np.concatenate((cosines[some], found[better]), axis=1)
            all_open = np.concatenate((open_[some], fresh[better]), axis=1)
            best = np.argpartition(-all_cosines, beam - 1, axis=1)[:, :beam]
            cosines[some] = np.take_along_axis(all_cosines, best, 1)
            ids[some] = np.where(cosines[some] > -np.inf, np.take_along_axis(all_ids, best, 1), NONE)
            open_[some] = np.take_along_axis(all_open, best, 1) & (cosines[some] > -np.inf)
    order = np.argsort(-cosines, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(cosines, order, 1)


def _diverse(vectors: np.ndarray, ids: np.ndarray, cosines: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the row's node than to any chosen before; free places go to the best of the rest."""
    got = vectors[np.maximum(ids, 0)]
    between = np.matmul(got, got.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, dtype=bool)
    for c in range(ids.shape[1]):
        hidden = (chosen & (between[:, c] > cosines[:, c : c + 1])).any(1)
        chosen[:, c] = (ids[:, c] >= 0) & ~hidden & (chosen.sum(1) < most)
    rank = np.where(ids < 0, 2, np.where(chosen, 0, 1)) * ids.shape[1] + np.arange(ids.shape[1])
    keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, keep, 1)


class Graph:
    """Layers over unit vectors; node k of layer l is row ``layers[l][0][k]`` of the vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        many = len(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(many) + 1e-12) / np.log(UPPER)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for height in range(int(level.max(initial=0)), -1, -1):
            rows = order[: int((level >= height).sum())]
            self.layers.append((rows, self._grow(rows, GROUND if height == 0 else UPPER)))

    def _grow(self, rows: np.ndarray, most: int) -> np.ndarray:
        """Links of one layer, its rows inserted in order in growing batches."""
        vectors = self.vectors[rows]
        links = np.full((len(rows), most), NONE, dtype=np.int32)
        done = 0
        while done < len(rows):
            new = np.arange(done, min(len(rows), done + max(64, min(BATCH, done))))
            inner = vectors[new] @ vectors[new].T
            inner[np.arange(len(new)), np.arange(len(new))] = -np.inf
            close = np.argsort(-inner, axis=1)[:, : min(most, len(new))]
            ids, cosines = new[close].astype(np.int32), np.take_along_axis(inner, close, 1)
            ids = np.where(cosines > -np.inf, ids, NONE)
            if done:
                entries = self._entries(vectors[new], rows, done)
                old_ids, old_cosines = search(vectors[:done], links[:done], vectors[new], entries, min(BUILD_BEAM, done))
                ids, cosines = np.concatenate((ids, old_ids), axis=1), np.concatenate((cosines, old_cosines), axis=1)
                best = np.argsort(-cosines, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, cosines = np.take_along_axis(ids, best, 1), np.take_along_axis(cosines, best, 1)
            picked = _diverse(vectors, ids, cosines, most)
            links[new, : picked.shape[1]] = picked
            self._answer(vectors, links, new, picked)
            done += len(new)
        return links

    def _answer(self, vectors: np.ndarray, links: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
        """Links back from the nodes that the new ones chose."""
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", vectors[source], vectors[target]), target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        rank = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate((first, [len(target)]))))
        few = rank < ARRIVALS
        nodes, row = np.unique(target[few], return_inverse=True)
        arrived = np.full((len(nodes), ARRIVALS), NONE, dtype=np.int32)
        arrived[row, rank[few]] = source[few]
        for k in range(0, len(nodes), 1024):
            part = slice(k, k + 1024)
            old = links[nodes[part]]
            arrived[part][(arrived[part][:, :, None] == old[:, None, :]).any(2)] = NONE
            ids = np.concatenate((old, arrived[part]), axis=1)
            cosines = np.where(ids >= 0, np.matmul(vectors[np.maximum(ids, 0)], vectors[nodes[part]][:, :, None])[:, :, 0], -np.inf)
            best = np.argsort(-cosines, axis=1, kind="stable")
            links[nodes[part]] = _diverse(vectors, np.take_along_axis(ids, best, 1), np.take_along_axis(cosines, best, 1), links.shape[1])

    def _entries(self, queries: np.ndarray, rows: np.ndarray, inserted: int) -> np.ndarray:
        """Entry nodes on the layer of ``rows`` (each layer starts with the rows of the one above): what the layers above find, and the layer's first node."""
        start = np.zeros((len(queries), 1), dtype=np.int32)
        for layer, links in self.layers:
            found, _ = search(self.vectors[layer], links, queries, start, 4)
            start = np.concatenate((found, np.zeros((len(queries), 1), dtype=np.int32)), axis=1)
            start[:, -1] = np.where((start[:, :-1] == 0).any(1), NONE, 0)
        return np.where(start < inserted, start, NONE)

    def near(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and single-precision cosines of the best ``beam`` vectors found for each query."""
        rows, links = self.layers[-1]
        queries = queries.astype(np.float32)
        upper, self.layers = self.layers, self.layers[:-1]
        try:
            start = self._entries(queries, rows, len(rows))
        finally:
            self.layers = upper
        ids, cosines = search(self.ordered, links, queries, start, min(beam, len(rows)))
        return np.where(ids >= 0, rows[np.maximum(ids, 0)], NONE), cosines

    @property
    def ordered(self) -> np.ndarray:
        if not hasattr(self, "_ordered"):
            self._ordered = self.vectors[self.layers[-1][0]]
        return self._ordered

    def to_bytes(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"rows{k}": x for k, (x, _) in enumerate(self.layers)}, **{f"links{k}": x for k, (_, x) in enumerate(self.layers)}, **more)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: str) -> tuple[Graph, dict[str, np.ndarray]]:
        held = dict(np.load(io.BytesIO(data)))
        graph = cls.__new__(cls)
        graph.vectors = held[vectors].astype(np.float32)
        graph.layers = [(held[f"rows{k}"], held[f"links{k}"]) for k in range(sum(x.startswith("rows") for x in held))]
        return graph, held
